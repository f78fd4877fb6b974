"""Full-text search, query joins and corpus preparation on Spark DataFrames."""
