"""Kinlink: a Spark-native engine for linking business records across sources."""
