"""Text and Parquet sources and sinks."""
