"""Regression analytics on Spark DataFrames: clean, derive, encode, fold, fit, blend."""
