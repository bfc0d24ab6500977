"""Relational, partitioning and ingest operators."""
