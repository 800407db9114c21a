"""Micro-batch appends and change feeds over snapshot tables."""
