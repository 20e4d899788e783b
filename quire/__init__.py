"""Spark-native analytics over documents as they are read."""
