"""A graph-query analytics engine on PySpark DataFrames."""
