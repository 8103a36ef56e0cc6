"""Relational building blocks on DataFrames."""
