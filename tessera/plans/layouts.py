"""Layouts of the data folder's tables that queries read through the catalog: written at their first use, and read from then on."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from tessera import storage
from tessera.catalog import Catalog, Layout, load
from tessera.sources import columnar

DATABASE = "tpch"
#: Keys that tables are bucketed by.
KEYS = {"lineitem": ("l_orderkey", "l_partkey"), "orders": ("o_orderkey",), "part": ("p_partkey",), "nation": ()}
PERVASIVE = ("nation",)


def _short(*about: object) -> str:
    return hashlib.sha1(" ".join(map(str, about)).encode()).hexdigest()[:16]


#: Tasks that the rows of a file need, by its state.
_needed: dict[tuple, int] = {}


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes of a file or folder, and when it was changed."""
    fs, p = storage.filesystem(spark, path)
    status = fs.getFileStatus(p)
    return storage.length(spark, path) if status.isDirectory() else status.getLen(), status.getModificationTime()


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of all layouts of a data folder: as many as shuffle partitions, or more if its largest table needs more tasks to be sorted in memory."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for table in (t for t, keys in KEYS.items() if keys):
        path = f"{sf_dir}/{table}.parquet"
        if storage.exists(spark, path):
            known = (path, *_state(spark, path), columnar.TASK_BYTES)
            if known not in _needed:
                _needed[known] = columnar.tasks_for(load(spark, sf_dir, table))
            n = max(n, _needed[known])
    return n


def read(spark: SparkSession, sf_dir: str, table: str, join_keys: tuple[str, ...] = (), filter_keys: tuple[str, ...] = ()) -> DataFrame:
    """A table through the layout that the catalog chooses. All layouts have the same number of buckets, so they join without an exchange.

    The catalog is that of the data folder, in the shared root; a table whose file is another than before is a table of its own.
    Of the keys that a table may be bucketed by, only those that are joined by get a layout: each is written when it is first asked for.
    """
    n = buckets(spark, sf_dir) if KEYS[table] else 1
    held = Catalog(spark, f"{storage.shared_root(spark)}/layouts-{_short(sf_dir, n)}")
    name = f"{table}_{_short(*_state(spark, f'{sf_dir}/{table}.parquet'))}"
    if DATABASE not in held.databases:
        held.create_database(DATABASE)
    if name not in held.databases[DATABASE]:
        held.define_table(DATABASE, name, load(spark, sf_dir, table).schema, pervasive=table in PERVASIVE)
    wanted = [Layout(key, key, n, bucketed=True, sort_key=key) for key in KEYS[table] if key in join_keys]
    there = held.table(DATABASE, name).layouts
    if not wanted and not there:
        wanted = [Layout(key, key, n, bucketed=True, sort_key=key) for key in KEYS[table][:1]] or [Layout("plain")]
    for layout in wanted:
        if layout.name not in there:
            held.add_layout(DATABASE, name, layout)
    store = held.store(DATABASE, name)
    if not store.batches:
        store.add(load(spark, sf_dir, table))
    return held.read(DATABASE, name, join_keys, filter_keys, store)
