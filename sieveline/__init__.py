"""Spark-native building, searching and evaluating of text knowledge bases."""
