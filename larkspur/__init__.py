"""Larkspur: a Spark-native document search, analytics and training-data engine."""
