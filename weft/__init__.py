"""Spark-native retrieval, timeline, session and evaluation operators."""
