"""Spark-native analytics for network state and policies that are only partly known."""

__version__ = "0.1.0"
