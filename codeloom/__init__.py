"""Spark-native analytics engine for repository data and training corpora."""
