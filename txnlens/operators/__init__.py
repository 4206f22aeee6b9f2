"""Cleaning, derived columns and reports; every function maps DataFrames to DataFrames."""
