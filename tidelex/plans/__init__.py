"""The index and the query language."""
