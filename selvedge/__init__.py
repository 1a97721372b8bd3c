"""Selvedge: corpus curation and model-output evaluation on Spark DataFrames."""
