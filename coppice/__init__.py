"""Interpretable-tree analytics on Spark: relational steps as DataFrames, search over small aggregates."""

__version__ = "0.1.0"
