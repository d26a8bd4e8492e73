"""Spark-native analytics for large unstructured meshes."""
