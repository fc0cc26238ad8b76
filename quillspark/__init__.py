"""A Spark-native engine for scholarly documents."""
