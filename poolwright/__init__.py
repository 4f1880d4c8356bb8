"""Spark-native analytics over coordination logs and message streams."""
