"""Spark-native analytics over collections of Markdown documents."""

__version__ = "0.1.0"
