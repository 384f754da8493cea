"""Spark-native code search, document search and usage analytics."""
