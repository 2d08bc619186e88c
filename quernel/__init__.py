"""Spark-native analytics for building, scoring and evaluating text detectors."""
