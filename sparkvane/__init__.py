"""sparkvane: partitioned vector search and stream analytics on Spark DataFrames."""
