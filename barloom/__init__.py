"""Spark-native analytics over financial bars."""
