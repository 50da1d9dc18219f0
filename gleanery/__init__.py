"""Spark-native analytics over collections of linked documents."""
