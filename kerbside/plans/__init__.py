"""Queries over the given tables, with the same in SQL."""
