"""Spark-native analytics for cyclic, multi-channel time series."""
