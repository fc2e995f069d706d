"""Sextant: a Spark-native content index and metadata search engine."""
