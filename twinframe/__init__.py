"""Paired-perturbation evaluation on Spark DataFrames."""
