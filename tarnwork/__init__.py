"""Knowledge retrieval and analytics on Spark DataFrames."""
