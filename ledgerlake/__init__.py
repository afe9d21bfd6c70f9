"""Spark-native transaction analytics."""
