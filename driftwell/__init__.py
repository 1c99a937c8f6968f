"""A PySpark-native engine for content-aggregation pipelines."""
