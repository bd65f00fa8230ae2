"""Spark-native analytics over collections of Markdown notes."""
