"""Spark-native cross-reference analytics over parsed design reports."""

__version__ = "0.1.0"
