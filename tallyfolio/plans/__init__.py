"""Whole batches, the registered queries and their SQL counterparts."""
