"""Spark-native log-risk analytics: parsing, features, detection, graphs, chains, risk."""
