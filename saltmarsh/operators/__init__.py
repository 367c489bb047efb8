"""Operators on market tables: DataFrame in, DataFrame out."""
