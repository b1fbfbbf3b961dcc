"""Spark-native temporal features, online ratings and evaluation for contest data."""
