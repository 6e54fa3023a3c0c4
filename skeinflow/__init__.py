"""Spark-native dataflow operators over conversation messages and documents."""

__version__ = "0.1.0"
