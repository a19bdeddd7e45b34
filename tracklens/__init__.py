"""Event-stream and object-track analytics on Spark DataFrames."""
