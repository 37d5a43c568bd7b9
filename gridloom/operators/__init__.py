"""Operators on DataFrames; every one is lazy unless it says otherwise."""
