"""Text-record analytics on Spark DataFrames: sources, cleansing, search, clustering, classification."""
