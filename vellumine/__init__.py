"""A document-analytics and retrieval engine built on Spark DataFrames."""
