"""Momentum analytics on Spark: every operator takes and returns DataFrames, and its clock is an argument."""
