"""Spark-native engine for short-video analytics tables."""
