"""Service-desk ticket analytics on Spark DataFrames, MLlib and Structured Streaming."""
