"""Genomic interval and sequence analytics on Spark DataFrames."""
