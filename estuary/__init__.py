"""Spark-native analytics for estuary and coastal model data."""
