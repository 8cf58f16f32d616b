"""logfathom: log hunting and analytics on Spark DataFrames."""
