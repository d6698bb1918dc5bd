"""Document-notes analytics on Spark DataFrames."""
