"""Time-series analytics on Spark: lists of series as DataFrames, and functions over them."""
