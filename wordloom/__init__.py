"""Spark-native text-structure analytics."""
