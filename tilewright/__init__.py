"""Spark-native analytics for tiles, per-object measurements, scores, spatial links and small rasters."""
