"""parley: conversation search, journals and retention on Spark DataFrames."""
