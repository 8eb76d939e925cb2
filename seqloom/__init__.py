"""Spark-native analytics for ordered event sequences."""
