"""Document verification and corpus processing on Spark DataFrames."""
