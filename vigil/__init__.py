"""Spark-native analytics over passive network metadata."""

__version__ = "0.1.0"
