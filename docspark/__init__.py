"""docspark: document and record analytics on Spark DataFrames."""
