"""kindred: identical and similar items in large collections, on Spark DataFrames."""
