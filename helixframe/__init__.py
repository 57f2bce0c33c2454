"""Spark-native omics analytics: DataFrame, SQL and Structured Streaming operators."""
