"""Spark-native exact-match sequence analytics."""
