"""Spark-native analytics for injection-detection studies."""
