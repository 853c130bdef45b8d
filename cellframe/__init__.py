"""cellframe: multi-dimensional query answering on Spark DataFrames."""
