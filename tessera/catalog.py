"""Tables with explicit schemas, their layouts, and the registry that chooses between layouts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera import storage

if TYPE_CHECKING:
    from tessera.operators.ingest import Store

#: Implicit first column of an ingested table: the batch it came with.
EPOCH = "__epoch"

#: Types by the names that table definitions use.
TYPES: dict[str, T.DataType] = {
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(),
    "INTEGER": T.IntegerType(),
    "SMALLINT": T.ShortType(),
    "TIME": T.LongType(),  # milliseconds of the day
    "TIMESTAMP": T.TimestampNTZType(),
    "TINYINT": T.ByteType(),
    "VARCHAR": T.StringType(),
    "VARBINARY": T.BinaryType(),
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(names: Sequence[str], types: Sequence[str]) -> T.StructType:
    """Checked schema of a table definition: names not empty, unique whatever their case, and not reserved; types known."""
    if len(names) != len(types):
        raise ValueError("as many types as names are needed")
    if not names:
        raise ValueError("a table needs a column")
    seen: set[str] = set()
    fields = []
    for name, kind in zip(names, types, strict=True):
        if not name:
            raise ValueError("empty column name")
        if name.lower() == EPOCH:
            raise ValueError(f"{EPOCH} is reserved")
        if name.lower() in seen:
            raise ValueError(f"column {name} appears twice")
        if kind.upper() not in TYPES:
            raise ValueError(f"unknown type {kind}")
        seen.add(name.lower())
        fields.append(T.StructField(name, TYPES[kind.upper()]))
    return T.StructType(fields)


@dataclass(frozen=True)
class Layout:
    """One physical form of a table: how rows are dealt, sorted and compressed."""

    name: str
    partition_key: str | None = None
    partitions: int = 8
    bucketed: bool = False
    sort_key: str | None = None
    codec: str = "snappy"
    linked_to: str | None = None  # a table whose layout has the same key, kind and number of partitions


@dataclass
class Table:
    """A logical table: its schema, layouts and batches."""

    name: str
    schema: T.StructType
    key: str = EPOCH
    pervasive: bool = False  # small enough to be on every node: joined by broadcast
    layouts: dict[str, Layout] = field(default_factory=dict)
    batches: dict[int, int] = field(default_factory=dict)  # batch id -> rows
    dropped: bool = False


class Catalog:
    """Databases of tables, with their layouts and batches.

    With a root folder, each change is written there before it counts (see storage.Journal), a new session opens what is there, and
    tables are kept and read under the root. Without one the catalog lives in memory.
    """

    def __init__(self, spark: SparkSession | None = None, root: str | None = None) -> None:
        self.databases: dict[str, dict[str, Table]] = {}
        self.spark, self.root, self.version = spark, root, 0
        self.journal = storage.Journal(spark, f"{root}/_catalog") if root else None
        if self.journal:
            self.version, state = self.journal.latest()
            for database, tables in (state or {}).items():
                self.databases[database] = {t["name"]: Table(t["name"], T.StructType.fromJson(t["schema"]), t["key"], t["pervasive"], {x["name"]: Layout(**x) for x in t["layouts"]}, dropped=t["dropped"]) for t in tables}

    def _commit(self) -> None:
        if self.journal:
            tables = {d: [{"name": t.name, "schema": t.schema.jsonValue(), "key": t.key, "pervasive": t.pervasive, "layouts": [asdict(x) for x in t.layouts.values()], "dropped": t.dropped} for t in held.values()] for d, held in self.databases.items()}
            self.version = self.journal.commit(self.version, tables)

    def create_database(self, name: str) -> None:
        if not name or name in self.databases:
            raise ValueError(f"bad or taken database name: {name!r}")
        self.databases[name] = {}
        self._commit()

    def drop_database(self, name: str) -> None:
        del self.databases[name]
        if self.root:
            storage.delete(self.spark, f"{self.root}/{name}")
        self._commit()

    def create_table(self, database: str, name: str, columns: Sequence[str], types: Sequence[str], key_index: int = -1, pervasive: bool = False) -> Table:
        """key_index: column by whose ranges batches are told apart; -1 for the implicit epoch."""
        tables = self.databases[database]
        if not name or name in tables:
            raise ValueError(f"bad or taken table name: {name!r}")
        return self.define_table(database, name, schema_of(columns, types), key_index, pervasive)

    def define_table(self, database: str, name: str, schema: T.StructType, key_index: int = -1, pervasive: bool = False) -> Table:
        """create_table() of a schema that is known."""
        tables, columns = self.databases[database], schema.names
        if not -1 <= key_index < len(columns):
            raise ValueError(f"no column {key_index}")
        tables[name] = Table(name, schema, EPOCH if key_index < 0 else columns[key_index], pervasive)
        self._commit()
        return tables[name]

    def table(self, database: str, name: str) -> Table:
        """Looked up with case."""
        t = self.databases[database][name]
        if t.dropped:
            raise KeyError(name)
        return t

    def drop_table(self, database: str, name: str, hard: bool = False) -> None:
        if hard:
            del self.databases[database][name]
            if self.root:
                storage.delete(self.spark, f"{self.root}/{database}/{name}")
        else:
            self.table(database, name).dropped = True
        self._commit()

    def add_column(self, database: str, table: str, name: str, kind: str) -> None:
        t = self.table(database, table)
        names = [f.name for f in t.schema]
        inverse = {str(v): k for k, v in TYPES.items()}
        t.schema = schema_of([*names, name], [*(inverse[str(f.dataType)] for f in t.schema), kind])
        self._commit()

    def drop_column(self, database: str, table: str, name: str) -> None:
        t = self.table(database, table)
        if name == t.key:
            raise ValueError(f"{name} tells the batches apart")
        if name not in t.schema.names:
            raise KeyError(name)
        t.schema = T.StructType([f for f in t.schema if f.name != name])
        self._commit()

    def add_layout(self, database: str, table: str, layout: Layout) -> Layout:
        """A linked layout takes key kind and number of partitions from what it is linked to, so the two join without a shuffle."""
        t = self.table(database, table)
        if layout.linked_to:
            other = next((x for x in self.table(database, layout.linked_to).layouts.values() if x.partition_key), None)
            if other is None:
                raise ValueError(f"{layout.linked_to} has no partitioned layout")
            layout = replace(layout, partitions=other.partitions, bucketed=other.bucketed)
        for column in (layout.partition_key, layout.sort_key):
            if column is not None and column not in t.schema.names:
                raise KeyError(column)
        t.layouts[layout.name] = layout
        self._commit()
        return layout

    def choose_layout(self, database: str, table: str, join_keys: Sequence[str] = (), filter_keys: Sequence[str] = ()) -> Layout:
        """The layout to read: one bucketed by a join key, else one sorted or ranged by a filtered column, else the first."""
        layouts = list(self.table(database, table).layouts.values())
        if not layouts:
            raise KeyError(table)

        def cost(x: Layout) -> tuple[int, int, int]:
            return (not (x.bucketed and x.partition_key in join_keys), not (x.sort_key in filter_keys), not (x.partition_key in (*join_keys, *filter_keys)))

        return min(layouts, key=cost)

    def store(self, database: str, table: str) -> Store:
        """The batches of a table: those that the root holds, or none yet."""
        from tessera.operators.ingest import Store

        t = self.table(database, table)
        path = f"{self.root}/{database}/{table}"
        try:
            held = Store.open(self.spark, path)
        except KeyError:
            return Store(self.spark, path, list(t.layouts.values()), t.key)
        for layout in t.layouts.values():
            if layout.name not in {x.name for x in held.layouts}:
                held.rewrite(held.layouts[0], layout)
        return held

    def read(self, database: str, table: str, join_keys: Sequence[str] = (), filter_keys: Sequence[str] = (), store: Store | None = None) -> DataFrame:
        """The rows of a table, from the layout that serves a query best. A pervasive table is broadcast, if its rows are few.

        store: the table's, if the caller has opened it."""
        from tessera.operators.relational import small

        t, held = self.table(database, table), store or self.store(database, table)
        rows = held.read(self.choose_layout(database, table, join_keys, filter_keys))
        return small(rows, sum(held.batches.values())) if t.pervasive else rows
