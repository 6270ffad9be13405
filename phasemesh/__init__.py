"""Spark-native analytics for complex-valued multichannel time series."""
