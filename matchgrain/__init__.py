"""Event analytics and exact selection on Spark DataFrames."""
