"""Operators for preparing text corpora: one module per operator, with its registered query."""
