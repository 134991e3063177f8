"""Spark-native analytics over ordered signals, sessions and text corpora."""
