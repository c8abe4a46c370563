"""Analytics operators: each takes tables as DataFrames and parameters and returns a lazy DataFrame."""
