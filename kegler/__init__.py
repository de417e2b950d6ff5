"""Spark-native analytics over tables of frames, detections and per-lane signals."""
