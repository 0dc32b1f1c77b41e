"""Reproducible training samples from multi-source text corpora, on Spark DataFrames."""
