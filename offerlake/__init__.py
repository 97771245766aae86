"""Spark-native offer search, query understanding and full-text analytics."""

__version__ = "0.1.0"
