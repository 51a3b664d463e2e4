"""Spark-native analytics of timed sensor streams."""
