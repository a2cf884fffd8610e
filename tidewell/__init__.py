"""Spark-native engine for web-corpus search, ranking and corpus preparation."""
