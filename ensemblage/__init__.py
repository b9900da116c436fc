"""Spark-native analytics over large collections of repeated stochastic experiments."""
