"""A Spark-native engine for retrieval over document collections."""
