"""Operators of a training-data pipeline: output formats, filters, counts, deduplication and packing."""
