"""Report operators: facts in, DataFrames out."""
