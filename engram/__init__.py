"""Spark-native project-memory analytics."""
