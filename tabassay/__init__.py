"""tabassay: profile, prepare, model and judge tabular data with Spark DataFrames."""
