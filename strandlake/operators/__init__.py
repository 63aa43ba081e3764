"""Relational operators of the imputation engine; each takes and returns DataFrames."""
