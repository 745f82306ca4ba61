"""Staged input, table layout and maintenance."""
