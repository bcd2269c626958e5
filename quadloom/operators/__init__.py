"""Joins, paths, adaptive joins, cardinality estimates and link filters."""
