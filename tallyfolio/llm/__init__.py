"""Operators for preparing training data, each with the query that applies it to its whole table."""
