"""A Spark-native engine for observation analytics."""
