"""Spark-native archive analytics: DataFrame operators over items, chunks, feeds and versions."""

__version__ = "0.1.0"
