"""Spark-native analytics for deduplicated artifact depots."""
