"""Forensic-artifact analytics with verifiable results, as plain Spark DataFrames."""

__version__ = "0.1.0"
