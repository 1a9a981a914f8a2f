"""The research operators: each one takes and returns DataFrames."""
