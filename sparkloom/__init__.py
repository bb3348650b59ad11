"""Spark-native analytics over labelled, ordered tables."""

__version__ = "0.1.0"
