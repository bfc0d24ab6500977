"""Batches of a table in several layouts: import, merge, rewrite, deal anew and rebuild after losses.

A table lies under one folder: <root>/<layout>/batch=<n>/range_id=<k>/*.parquet, or <root>/<layout>/batch=<n>/*.parquet for a
bucketed layout. Reading all batches is the union of their rows; a batch is the unit that is imported, merged or rebuilt. What
batches, layouts and ranges there are is in <root>/_state, one file for each change: data are written first and count once the
state that names them is, so a job that was cut off leaves nothing behind but files that no state names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import storage
from tessera.catalog import EPOCH, Layout
from tessera.operators.ranges import Range, design, from_json, overlap, range_id, to_json
from tessera.sources.columnar import tasks_for, write_bucketed


@dataclass
class Store:
    """The batches of one table. key: a column by whose values batches are told apart: no two may share a value's range."""

    spark: SparkSession
    root: str
    layouts: list[Layout]
    key: str | None = None
    ranges: dict[str, list[Range]] = field(default_factory=dict)
    batches: dict[int, int] = field(default_factory=dict)
    spans: dict[int, tuple[Any, Any]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    log: list[tuple[str, int, str]] = field(default_factory=list)
    schema: T.StructType | None = None
    version: int = 0

    def __post_init__(self) -> None:
        self.key = None if self.key == EPOCH else self.key
        self.journal = storage.Journal(self.spark, f"{self.root}/_state")

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        """A store as its last state says; KeyError if there is none."""
        version, state = storage.Journal(spark, f"{root}/_state").latest()
        if state is None:
            raise KeyError(root)
        return cls(
            spark,
            root,
            [Layout(**x) for x in state["layouts"]],
            state["key"],
            {k: [Range(from_json(a), from_json(b)) for a, b in v] for k, v in state["ranges"].items()},
            {int(k): n for k, n in state["batches"].items()},
            {int(k): (from_json(a), from_json(b)) for k, (a, b) in state["spans"].items()},
            state["streams"],
            [tuple(x) for x in state["log"]],
            T.StructType.fromJson(state["schema"]) if state["schema"] else None,
            version,
        )

    def _commit(self) -> None:
        state = {
            "layouts": [asdict(x) for x in self.layouts],
            "key": self.key,
            "ranges": {k: [(to_json(r.start), to_json(r.end)) for r in v] for k, v in self.ranges.items()},
            "batches": self.batches,
            "spans": {k: (to_json(a), to_json(b)) for k, (a, b) in self.spans.items()},
            "streams": self.streams,
            "log": self.log,
            "schema": self.schema.jsonValue() if self.schema else None,
        }
        self.version = self.journal.commit(self.version, state)

    def path(self, layout: Layout, batch: int | None = None, part: int | None = None) -> str:
        out = f"{self.root}/{layout.name}"
        if batch is not None:
            out += f"/batch={batch}"
        if part is not None:
            out += f"/range_id={part}"
        return out

    def _note(self, what: str, batch: int, status: str) -> None:
        self.log.append((what, batch, status))

    def _dealt(self, df: DataFrame, layout: Layout, tasks: int | None = None) -> DataFrame:
        """df with its ranges, dealt and sorted for writing: a task for each range, or, if the rows need more, tasks of like size.

        Those are cut in the order of range and sort key, and what is equal in these by a hash, so neither a range nor a value is too large for
        its tasks; the files of a range, by name, follow each other in its order. tasks: what tasks_for() gives for df, if it is known.
        """
        key = [layout.sort_key] if layout.sort_key else []
        if layout.partition_key:
            ranges = self.ranges[layout.name]
            out = df.withColumn("range_id", range_id(F.col(layout.partition_key), ranges))
            tasks = tasks or tasks_for(df)
            if tasks == 1:
                out = out.repartitionById(len(ranges), F.col("range_id"))
            else:
                same = F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, T.AtomicType)))
                out = out.repartitionByRange(max(tasks, len(ranges)), "range_id", *key, same)
        else:
            out = df.withColumn("range_id", F.lit(0))
        return out.sortWithinPartitions("range_id", *key)

    def _write(self, df: DataFrame, layout: Layout, batch: int, tasks: int | None = None) -> None:
        if layout.bucketed:
            name = f"tessera_{hashlib.sha1(self.path(layout, batch).encode()).hexdigest()}"
            write_bucketed(df, name, self.path(layout, batch), layout)
            self.spark.sql(f"DROP TABLE {name}")  # the files stay
            return
        self._dealt(df, layout, tasks).write.mode("overwrite").option("compression", layout.codec).partitionBy("range_id").parquet(self.path(layout, batch))

    def add(self, df: DataFrame, stream: tuple[str, int] | None = None) -> int:
        """Imports a batch into every layout: the first by dealing the rows, the others from it. Returns the batch's number.

        stream: the name of a stream and the number of its batch, recorded together with the batch. A batch whose keys overlap with
        those of another is refused with ValueError.
        """
        batch = max(self.batches, default=-1) + 1
        span = tuple(df.agg(F.min(self.key), F.max(self.key)).first()) if self.key else (None, None)
        for other, held in self.spans.items():
            if overlap(span, held):
                raise ValueError(f"keys from {span[0]} to {span[1]} overlap with batch {other}, {held[0]} to {held[1]}")
        self._note("import", batch, "running")
        for layout in self.layouts:
            if layout.partition_key and not layout.bucketed and layout.name not in self.ranges:
                self.ranges[layout.name] = design(df, layout.partition_key, layout.partitions)
        self.schema = df.schema
        first = self.layouts[0]
        tasks = tasks_for(df) if any(x.partition_key and not x.bucketed for x in self.layouts) else None
        self._write(df, first, batch, tasks)
        for layout in self.layouts[1:]:
            self._write(self.read(first, [batch]), layout, batch, tasks)
        self.batches[batch], self.spans[batch] = self.read(first, [batch]).count(), span
        if stream:
            self.streams[stream[0]] = stream[1]
        self._note("import", batch, "done")
        self._commit()
        return batch

    def skip_stream(self, stream: tuple[str, int]) -> None:
        """Records a batch of a stream that holds no rows."""
        self.streams[stream[0]] = stream[1]
        self._commit()

    def table(self, layout: Layout) -> DataFrame:
        """All batches of a bucketed layout as one bucketed table, registered with this session: joins and groups by its key need no exchange."""
        name = f"tessera_{hashlib.sha1(f'{self.path(layout)} {self.version}'.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            sort = layout.sort_key or layout.partition_key
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}, __batch INT) USING parquet PARTITIONED BY (__batch) CLUSTERED BY (`{layout.partition_key}`) SORTED BY (`{sort}`) INTO {layout.partitions} BUCKETS LOCATION '{self.path(layout)}'")
            for batch in sorted(self.batches):
                self.spark.sql(f"ALTER TABLE {name} ADD PARTITION (__batch = {batch}) LOCATION '{self.path(layout, batch)}'")
        return self.spark.table(name).drop("__batch")

    def read(self, layout: Layout | None = None, batches: Sequence[int] | None = None) -> DataFrame:
        """The rows of some batches, or of all; filters on range_id, or on the sort key, skip files or row groups."""
        layout = layout or self.layouts[0]
        if layout.bucketed and batches is None and self.batches:
            return self.table(layout)
        paths = [self.path(layout, b) for b in (batches if batches is not None else sorted(self.batches))]
        return self.read_parts(layout, paths).drop("range_id")

    def read_parts(self, layout: Layout, paths: list[str]) -> DataFrame:
        """As read(), with the range that each row is in."""
        schema = T.StructType([*self.schema.fields, T.StructField("range_id", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        if layout.bucketed:
            return self.spark.read.schema(self.schema).parquet(*paths).withColumn("range_id", F.lit(0))
        out = None
        for p in paths:
            part = self.spark.read.schema(schema).option("basePath", p).parquet(p)
            out = part if out is None else out.unionByName(part)
        return out

    def merge(self, batches: Sequence[int]) -> int:
        """Replaces batches, two or more, by one with all their rows."""
        if len(set(batches)) < 2 or not set(batches) <= set(self.batches):
            raise ValueError("two or more batches of this table are needed")
        new = max(self.batches) + 1
        self._note("merge", new, "running")
        for layout in self.layouts:
            self._write(self.read(layout, batches), layout, new)
        rows = self.read(self.layouts[0], [new]).count()
        if rows != sum(self.batches[b] for b in batches):
            raise RuntimeError("the merged batch has other rows than its sources")
        ends = [x for b in batches for x in self.spans[b] if x is not None]
        self.spans[new] = (min(ends), max(ends)) if ends else (None, None)
        for b in batches:
            del self.batches[b], self.spans[b]
        self.batches[new] = rows
        self._note("merge", new, "done")
        self._commit()
        # Only when the new batch counts do the old ones go.
        for b in batches:
            for layout in self.layouts:
                storage.delete(self.spark, self.path(layout, b))
        return new

    def vacuum(self) -> list[str]:
        """Deletes the folders of batches that the state does not name, left by jobs that were cut off."""
        gone = []
        for layout in self.layouts:
            for name in storage.names(self.spark, self.path(layout)):
                if name.startswith("batch=") and int(name[6:]) not in self.batches:
                    storage.delete(self.spark, f"{self.path(layout)}/{name}")
                    gone.append(f"{layout.name}/{name}")
        return gone

    def rewrite(self, source: Layout, target: Layout) -> None:
        """Adds a layout, made from another one: other sort key, codec, partition key or ranges."""
        if target.partition_key and not target.bucketed and target.name not in self.ranges:
            same = not source.bucketed and target.partition_key == source.partition_key and target.partitions == source.partitions
            self.ranges[target.name] = self.ranges[source.name] if same else design(self.read(source), target.partition_key, target.partitions)
        for b in self.batches:
            self._write(self.read(source, [b]), target, b)
        self.layouts.append(target)
        self._commit()

    def lost(self, layout: Layout, batch: int) -> list[int]:
        """Ranges, or buckets, of a batch that have rows in another layout, but no files in this one."""
        have = {k for k in range(len(self.ranges.get(layout.name, [None]))) if storage.exists(self.spark, self.path(layout, batch, k))}
        other = next(x for x in self.layouts if x.name != layout.name and storage.exists(self.spark, self.path(x, batch)))
        rows = self.read(other, [batch])
        if layout.bucketed:
            have = {int(n.split("_")[-1].split(".")[0]) for n in storage.names(self.spark, self.path(layout, batch)) if n.startswith("part-")}
            want = {r[0] for r in rows.select(F.pmod(F.hash(layout.partition_key), F.lit(layout.partitions)).alias("k")).distinct().collect()}
            return sorted(want - have)
        ids = range_id(F.col(layout.partition_key), self.ranges[layout.name]) if layout.partition_key else F.lit(0)
        want = {r[0] for r in rows.select(ids.alias("k")).distinct().collect()}
        return sorted(want - have)

    def rebuild(self, layout: Layout, batch: int, source: Layout | None = None) -> list[int]:
        """Writes the lost ranges of a batch again, from another layout; returns them.

        With the same key and ranges in the source, only its files of those ranges are read; else all are, filtered by range.
        """
        parts = self.lost(layout, batch)
        if not parts:
            return []
        if source is None:
            source = min((x for x in self.layouts if x.name != layout.name), key=lambda x: self.ranges.get(x.name) != self.ranges.get(layout.name))
        self._note("rebuild", batch, "running")
        if layout.bucketed:
            # The files of a batch are written together.
            self._write(self.read(source, [batch]), layout, batch)
            self._note("rebuild", batch, "done")
            self._commit()
            return parts
        if layout.partition_key and source.name in self.ranges and self.ranges.get(source.name) == self.ranges[layout.name] and source.partition_key == layout.partition_key:
            rows = self.read_parts(source, [self.path(source, batch)]).where(F.col("range_id").isin(parts)).drop("range_id")
        else:
            rows = self.read(source, [batch])
            if layout.partition_key:
                rows = rows.where(range_id(F.col(layout.partition_key), self.ranges[layout.name]).isin(parts))
        dealt = self._dealt(rows, layout)
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            dealt.write.mode("overwrite").option("compression", layout.codec).partitionBy("range_id").parquet(self.path(layout, batch))
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        self._note("rebuild", batch, "done")
        self._commit()
        return parts

    def compact_log(self) -> int:
        """Keeps the last entry of each job; returns how many went."""
        last = {(what, batch): status for what, batch, status in self.log}
        gone = len(self.log) - len(last)
        self.log = [(what, batch, status) for (what, batch), status in last.items()]
        self._commit()
        return gone
