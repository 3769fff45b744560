"""Modal decomposition of space-time fields on Spark DataFrames."""
