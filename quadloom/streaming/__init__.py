"""Incremental results."""
