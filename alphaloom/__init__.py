"""Spark-native cross-sectional factor analytics, with operators for training-data pipelines."""
