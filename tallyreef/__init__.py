"""Spark-native engine for release and application tracking data."""
