"""Spark-native analytics over corpora of labelled calls, their audio segments and texts."""

__version__ = "0.1.0"
