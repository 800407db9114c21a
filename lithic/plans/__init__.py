"""Statement parsing, answers from metadata, and the query inventory."""
