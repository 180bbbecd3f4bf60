"""Spark-native operators for retrieval, rule evaluation and event-driven care workflows."""
