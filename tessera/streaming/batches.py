"""Incremental ingest: files that have arrived become batches of a store, each once."""

from __future__ import annotations

from pyspark.sql import types as T

from tessera.operators.ingest import Store


def ingest_arrivals(store: Store, source: str, schema: T.StructType, checkpoint: str, files_per_batch: int = 100) -> list[int]:
    """Takes the Parquet files under source that no earlier call took; returns the numbers of the new batches. Empty batches are left out.

    Spark may give a batch of the stream again after a failure. Its number is in the store's state together with the data, by the
    name of the stream, which is its checkpoint; a number that the state has is not taken again, whatever session asks.
    """
    stream = store.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    added: list[int] = []

    def take(df, number: int) -> None:
        if number <= store.streams.get(checkpoint, -1):
            return
        if df.isEmpty():
            store.skip_stream((checkpoint, number))
        else:
            added.append(store.add(df, stream=(checkpoint, number)))

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return added
