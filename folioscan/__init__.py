"""Folioscan: Spark-native table normalisation and evidence retrieval."""

__version__ = "0.1.0"
