"""Spark-native analytics for media-codec experiments and device telemetry."""
