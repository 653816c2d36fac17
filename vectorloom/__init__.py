"""Spark-native vector analytics: collections, quantised search, change capture, tensor files."""

__version__ = "0.1.0"
