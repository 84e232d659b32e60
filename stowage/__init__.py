"""Archive analytics and corpus preparation on Spark DataFrames."""
