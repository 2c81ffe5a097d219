"""Spark-native analytics for brand visibility in AI answers and search results."""
