"""Citation and manuscript analytics on Spark DataFrames."""
