"""Spark-native analytics over collections of dated, attributed research notes."""
