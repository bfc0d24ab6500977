"""Registered queries: each with the Spark plan and DuckDB SQL for the same rows."""
