"""Tessera: evidence retrieval, answer verification and text pipelines on Spark DataFrames."""

__version__ = "0.1.0"
