"""Spark-native street-network analytics."""
