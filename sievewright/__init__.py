"""Spark-native curation, ranking and data-quality engine for heterogeneous measurement tables."""

__version__ = "0.1.0"
