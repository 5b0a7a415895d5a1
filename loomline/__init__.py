"""Spark-native analytics for hourly series joined with timestamped text."""
