"""A Spark-native engine for retrieval, ranking and search-quality analytics."""
