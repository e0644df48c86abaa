"""Change-data-capture operators for Spark DataFrames."""
