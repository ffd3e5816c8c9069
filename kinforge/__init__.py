"""Family-tree analytics on Spark DataFrames."""
