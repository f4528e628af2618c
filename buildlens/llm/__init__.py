"""Operators for preparing training data at scale: one module per operator, all on Spark DataFrames."""
