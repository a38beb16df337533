"""A Spark-native engine for code retrieval and corpus analytics."""
