"""Spark-native analytics over media-processing ledgers."""
