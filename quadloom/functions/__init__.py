"""Scalar functions and aggregates with SPARQL error semantics."""
