"""lorespark: knowledge search, graph and corpus analytics on Spark DataFrames."""
