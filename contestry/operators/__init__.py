"""Relational and model operators: DataFrames in, DataFrame out."""
