"""A versioned key-value table engine on Spark DataFrames."""
