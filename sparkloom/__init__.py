"""Spark-native code retrieval, token accounting and corpus preparation."""
