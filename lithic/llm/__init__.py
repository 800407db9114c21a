"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Ten operators live in one module
each; ``registry`` holds the ``opN_*`` queries and their SQL.
"""
