"""Dataset preparation as functions from DataFrames to DataFrames."""
