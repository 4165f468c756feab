"""Spark-native document classification analytics."""
