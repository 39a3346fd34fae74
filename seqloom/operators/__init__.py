"""Operators over DataFrames of references, reads and index tables."""
