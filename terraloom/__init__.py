"""Spark-native analytics for rasters, point clouds, match networks and sensor time series."""
