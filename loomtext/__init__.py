"""Spark-native text and code corpus analytics."""
