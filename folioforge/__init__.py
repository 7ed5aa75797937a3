"""folioforge: document-library analytics on Spark DataFrames."""
