"""Object-metadata and event analytics on Spark DataFrames."""
