"""Spark-native analytics for low-altitude drone corridors."""
