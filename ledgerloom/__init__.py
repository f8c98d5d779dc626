"""Order-to-cash flow analytics on Spark DataFrames."""
