"""Panel and time-series analytics on Spark DataFrames."""
