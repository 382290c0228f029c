"""Corvane: hybrid retrieval and knowledge-graph analytics over text collections, on Spark DataFrames."""

__version__ = "0.1.0"
