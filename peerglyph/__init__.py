"""Spark-native analytics for visual look-alikes of characters."""
