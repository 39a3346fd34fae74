"""Reads that arrive over time."""
