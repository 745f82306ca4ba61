"""Spark-native observability lake: ingest, table layout and DataFrame operators."""
