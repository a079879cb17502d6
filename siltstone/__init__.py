"""siltstone: a Spark-native engine for document and vector collections."""
