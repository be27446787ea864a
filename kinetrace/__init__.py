"""Spark-native analytics for robot-trajectory datasets."""
