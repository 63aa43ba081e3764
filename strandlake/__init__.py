"""Haplotype analytics on Spark DataFrames."""
