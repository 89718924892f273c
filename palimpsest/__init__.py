"""Spark-native analytics over versioned, content-addressed snapshot catalogs."""
