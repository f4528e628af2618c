"""Build-health analytics over Spark DataFrames."""
