"""Spark-native engine for access-controlled document analytics."""
