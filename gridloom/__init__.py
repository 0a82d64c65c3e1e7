"""A Spark-native engine for spatial and temporal analysis."""
