"""Spark-native engine for dotted-name metric points: ingest, filter, aggregate, roll up, route, query."""
