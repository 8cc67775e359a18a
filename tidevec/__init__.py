"""Spark-native analytics over streams of vectors."""

__version__ = "0.1.0"
