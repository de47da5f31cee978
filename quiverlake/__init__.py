"""A Spark-native vector, text and hybrid search engine."""
