"""Tessera: a Spark-native analytics engine for partitioned star-schema data."""
