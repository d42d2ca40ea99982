"""Spark-native code-graph analytics."""
