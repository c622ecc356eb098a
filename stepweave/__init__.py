"""Training-trace and model-graph analytics on Spark DataFrames."""
