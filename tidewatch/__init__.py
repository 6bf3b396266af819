"""Tracks, radar detections and cited documents on Spark."""
