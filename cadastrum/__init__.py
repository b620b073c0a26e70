"""Spark-native analytics over property sales and local income indicators."""
