"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Workspace, cut_points, slices, small_batches
from tessera.llm.text import BLANK

_STRIP = BLANK.encode()


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, places, keys = [], [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for k, line in enumerate((text or b"").lower().split(b"\n")):
                    key = line.strip(_STRIP)
                    if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
                        ids.append(i)
                        places.append(k)
                        keys.append(hashlib.blake2b(key, digest_size=16).digest())
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["id", "pos", "h1", "h2"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n_lines, n_dropped, kept = [], [], []
        for text, drops in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist(), strict=True):
            text = text or b""
            n_lines.append(text.count(b"\n") + 1)
            n_dropped.append(len(drops or ()))
            if drops:
                gone = set(drops)
                text = b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in gone)
            kept.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_lines", "n_dropped", "kept"])


class LineRuns:
    """Runs of line hashes, each with the document that keeps the line, in levels of at most fanout - 1 runs.

    A run is a table bucketed and sorted by hash, one file a bucket, so that a batch that is dealt by hash meets
    it in a merge join without dealing or sorting the run again. A batch is written once, as a run: the lines that were new with it are
    marked, so no hash counts in two runs, and so are those that repeat. When a level has fanout runs, what was new in them is merged into
    one of the next level.
    """

    def __init__(self, ws: Workspace, fanout: int = 3):
        self.ws, self.fanout = ws, fanout
        self.levels: list[list[str]] = []
        self.buckets = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> str:
        name = f"tessera_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.ws.path(name)).saveAsTable(name)
        return name

    def _new(self, run: str) -> DataFrame:
        return self.ws.spark.table(run).where("fresh").select("h1", "h2", "keep")

    def _drop(self, *names: str) -> None:
        for name in names:
            self.ws.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.ws.drop(*names)

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes the next batch, of larger ids than those before; returns (id, drops: positions of the lines to drop)."""
        state = lines.groupBy("h1", "h2").agg(F.min("id").alias("own"), F.max("id").alias("last"))
        seen = []
        for level in self.levels:
            for run in level:
                seen.append(f"k{len(seen)}")
                state = state.join(self._new(run).withColumnRenamed("keep", seen[-1]), ["h1", "h2"], "left")
        old = F.coalesce(*(F.col(x) for x in seen)) if seen else F.lit(None).cast("long")
        # One pass over the runs tells both: lines without a match are new, lines that another document holds repeat. The groups are dealt
        # as the buckets are, so each bucket is written by one task.
        state = state.select("h1", "h2", F.coalesce(old, "own").alias("keep"), old.isNull().alias("fresh"), (old.isNotNull() | (F.col("own") < F.col("last"))).alias("repeated"))
        run = self._write(state)
        # Read without the buckets, so dealt anew on both sides: a line that a third of the documents hold can be split.
        repeated = self.ws.spark.read.schema(state.schema).parquet(self.ws.path(run)).where("repeated").select("h1", "h2", "keep")
        drops = lines.join(repeated.hint("merge"), ["h1", "h2"]).where("id <> keep").groupBy("id").agg(F.collect_list("pos").alias("drops"))
        drops = self.ws.stash(drops, f"drops-{uuid.uuid4().hex}")
        self._push(run, 0)
        return drops

    def _push(self, run: str, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self.levels[level] = []
            union = None
            for name in old:
                part = self._new(name)
                union = part if union is None else union.union(part)
            merged = self._write(union.withColumn("fresh", F.lit(True)).repartition(self.buckets, "h1", "h2"))
            self._drop(*old)
            self._push(merged, level + 1)

    def close(self) -> None:
        self._drop(*(x for level in self.levels for x in level))
        self.levels = []


@small_batches
def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Drops lines whose key another document of smaller id holds.

    Returns (id, n_lines, n_dropped, kept: the text that is left, in UTF-8), one row for each row of docs. A line's key
    is the line stripped of ASCII white space and with A-Z lower-cased; keys of fewer than least code points stay.
    Documents are taken in `batches` ranges of ascending id. Null text is one empty line. Rows with a null id keep all
    lines and count for no other document; rows that repeat an id count as one document. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "lines")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    cuts = cut_points(rows, "id", batches)
    lines = ws.stash(rows.where("id is not null").mapInArrow(_lines(least), "id long, pos int, h1 long, h2 long"), "lines")
    ranges = [F.lit(True)]
    for cut in cuts:
        ranges[-1] = ranges[-1] & (F.col("id") <= cut)
        ranges.append(F.col("id") > cut)
    sorted_scan = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(sorted_scan)
    spark.conf.set(sorted_scan, "true")
    runs = LineRuns(ws, fanout)
    try:
        drops = [runs.add(lines.where(x)) for x in ranges]
    finally:
        runs.close()
        spark.conf.set(sorted_scan, before)
    ws.drop("lines")
    every = drops[0]
    for x in drops[1:]:
        every = every.union(x)
    # The same plan at every size: the drops grow with the documents, so they are never broadcast.
    return rows.join(every.hint("merge"), "id", "left").select("id", "text", "drops").mapInArrow(_without, "id long, n_lines long, n_dropped long, kept binary")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of dedup_lines over documents."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), held AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (h.key IS NOT NULL AND h.first <> k.doc_id) AS gone FROM keyed k LEFT JOIN held h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
