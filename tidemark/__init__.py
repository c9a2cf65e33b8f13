"""Lineage of SQL and preparation of text corpora on Spark."""

__version__ = "0.2.0"
