"""Document structuring and evaluation on Spark DataFrames."""
