"""Time-series panel analytics on Spark DataFrames."""
