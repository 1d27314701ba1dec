"""Finite-state analytics of tabular data on Spark DataFrames."""

__version__ = "0.1.0"
