"""Synthetic arithmetic over Spark DataFrames, with a training-data subpackage beside it."""
