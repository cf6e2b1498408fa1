"""trackfold: analytics over tracked objects, written for Spark DataFrames."""
