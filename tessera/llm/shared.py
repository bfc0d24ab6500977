"""Working folders, lineage cuts and grouped streams that the operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import storage


#: Rows that a function looks at together. Texts are long, so this keeps the Python workers small.
ROWS = 256
#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows that a scan decodes together: the arrays of Spark's default, 4,096 texts or lists of ids, are so large that the JVM's heap grows by them.
READ_ROWS = 512
_READ = "spark.sql.parquet.columnarReaderBatchSize"


def bound_batches(spark: SparkSession) -> None:
    """Bounds the batches of a session by BATCH_BYTES: for those who own the session, as a plan that an operator returns runs with its settings."""
    spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def bound_reads(spark: SparkSession) -> None:
    """Bounds the rows that the scans of a session decode together by READ_ROWS: for those who own the session, as above."""
    spark.conf.set(_READ, str(READ_ROWS))


_watching: list[list[Workspace]] = []


def small_batches(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stages that an operator (of a DataFrame and more) runs by itself send batches of BATCH_BYTES; then the session is as before."""

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        conf = df.sparkSession.conf
        before = conf.get(_BATCH)
        bound_batches(df.sparkSession)
        try:
            return operator(df, *args, **kwargs)
        finally:
            conf.set(_BATCH, before)

    return run


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ROWS rows, whatever the session sends."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


class Workspace:
    """A folder of written tables in the shared root. Tables survive lost executors and cut the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = storage.scratch(spark, name)
        for found in _watching:
            found.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns it as read back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def remove(self) -> None:
        """Deletes all tables, when nothing reads them any more."""
        storage.delete(self.spark, self.root)

    def drop(self, *names: str) -> None:
        """Deletes written tables, and shuffle files of plans that nothing refers to any more."""
        for name in names:
            storage.delete(self.spark, self.path(name))
        gc.collect()
        self.spark._jvm.System.gc()


@contextmanager
def removed_at_end() -> Iterator[None]:
    """Removes the workspaces that operators make within: for callers who have then written or used the results."""
    found: list[Workspace] = []
    _watching.append(found)
    try:
        yield
    finally:
        _watching.remove(found)
        for ws in found:
            ws.remove()


def connected_components(ws: Workspace, edges: DataFrame, tag: str) -> DataFrame:
    """(node, component) for the end points of edges (u, v); component is the smallest node reachable.

    Contracts the graph round by round: every node joins its smallest neighbour, edges are renamed to what
    their ends joined, and those inside one group go. Each round is written to the shared folder; nothing is collected.
    """
    spark = ws.spark
    left = ws.stash(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{tag}-e0")
    total, k = None, 0
    while not left.isEmpty():
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = both.groupBy("u").agg(F.least("u", F.min("v")).alias("to"))
        # One jump: what a node joined has itself joined something smaller.
        hop = step.select(F.col("u").alias("to"), F.col("to").alias("far"))
        step = ws.stash(step.join(hop, "to").select("u", F.col("far").alias("to")), f"{tag}-m{k}")
        a = step.select("u", F.col("to").alias("a"))
        b = step.select(F.col("u").alias("v"), F.col("to").alias("b"))
        named = left.join(a, "u").join(b, "v").where("a <> b")
        left = ws.stash(named.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"{tag}-e{k + 1}")
        if total is None:
            total = step.select(F.col("u").alias("node"), F.col("to").alias("component"))
        else:
            later = step.select(F.col("u").alias("component"), "to")
            total = total.join(later, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        k += 1
    if total is None:
        return spark.createDataFrame([], "node long, component long")
    return ws.stash(total, f"{tag}-cc")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of a stream that is sorted by integer keys without nulls; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(int(c[lo]) for c in cols)
            if key != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                held, now = [], key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that starts like `name` and that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut_points(df: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 ascending values that cut df into n ranges of about as many rows."""
    known = df.select(column).where(F.col(column).isNotNull())
    return sorted({int(x) for x in known.approxQuantile(column, [k / n for k in range(1, n)], 0.2 / n)}) if n > 1 else []
