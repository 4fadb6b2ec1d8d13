"""Spark-native interpretable time-series analytics."""
