"""Fragment-assignment analytics on Spark DataFrames."""
