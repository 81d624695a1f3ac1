"""A PySpark-native recommendation-analytics engine."""
