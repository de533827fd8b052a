"""Spark-native analytics over object-centric 3D scenes."""
