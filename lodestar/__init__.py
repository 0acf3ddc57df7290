"""lodestar: a Spark-native vector data engine."""
