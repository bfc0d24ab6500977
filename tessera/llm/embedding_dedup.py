"""Embedding near-dedup by collision counting over one-dimensional projections.

Unit vectors at cosine c lie sqrt(2 - 2c) apart, so the difference of their projections on a random Gaussian direction
is normal with that deviation. On each projection, sorted, the window centred at a query holds the vectors within
REACH deviations; a pair's collisions over all projections are then binomial, and the least count that a pair
at the threshold reaches, but for MISS of them, follows. Pairs with that count are verified by their cosine.

Vectors are dealt in blocks, and pairs of blocks are cells of bounded size. Each vector belongs to its nearest pivot; by the
triangle inequality a vector can be near one of another pivot's only if the two pivots are no farther apart than its own distance, that
ball's radius and the distance at the threshold together, and it goes only to the cells of blocks with such a ball.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.ngram_join import stars
from tessera.llm.shared import Workspace, connected_components, grouped, slices, small_batches

PROJECTIONS = 24
#: Half a window, in deviations of a pair at the threshold.
REACH = 1.6
#: Expected share of pairs at the threshold that the count loses.
MISS = 1e-6
#: Vectors of a block, about.
BLOCK = 2048
#: Pivots, for vectors of one length, and vectors that they are chosen from: each the farthest from those before.
PIVOTS, PIVOT_SAMPLE = 256, 4096
#: Numbers held at a time when pairs are verified.
HELD_NUMBERS = 1 << 22


def needed(projections: int = PROJECTIONS, reach: float = REACH, miss: float = MISS) -> int:
    """The largest count that all but `miss` of the pairs at the threshold reach."""
    p = erf(reach / sqrt(2))
    below = 0.0
    for k in range(projections + 1):
        below += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > miss:
            return k
    return projections


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, data, k1, k2 = [], [], [], []
        for v, label, vec_id in zip(batch.column("v").to_pylist(), batch.column("label").to_pylist(), batch.column("id").to_pylist(), strict=True):
            x = None
            if v and label is not None and vec_id is not None and None not in v:
                x = np.array(v, np.float64)
                with np.errstate(over="ignore"):
                    x = x if np.isfinite(x).all() and x.any() else None
            raw = x.tobytes() if x is not None else None
            pair = np.frombuffer(hashlib.blake2b(raw or b"", digest_size=16, key=str(label).encode()).digest(), np.int64)
            sizes.append(len(x) if x is not None else 0)
            data.append(raw)
            k1.append(pair[0])
            k2.append(pair[1])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(data, pa.binary()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], ["id", "label", "dim", "vec", "k1", "k2"])


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in raw])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _assign(shared):
    """Adds to each vector its nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raw = batch.column("dim").to_numpy(), batch.column("vec").to_pylist()
            pivot, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                p = shared.value[int(d)]
                x = _unit([raw[k] for k in at])
                pivot[at] = np.argmax(x @ p.T, 1)
                far[at] = np.sqrt(((x - p[pivot[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(far)], [*batch.schema.names, "pivot", "far"])

    return run


def _pivots(x: np.ndarray) -> np.ndarray:
    """Rows of x, each the farthest from those before, PIVOTS of them at most; none is close to another, as long as others are left."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(PIVOTS, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    return _chain(x[chosen])


def _chain(p: np.ndarray) -> np.ndarray:
    """p in an order in which each is the nearest of those left to the one before."""
    left, order = list(range(1, len(p))), [0]
    while left:
        order.append(left.pop(int(np.argmax(p[left] @ p[order[-1]]))))
    return p[order]


def _deal(ws: Workspace, distinct: DataFrame, cosine: float) -> DataFrame:
    """(g1, g2, i, j, id, k2, many, vec, block): every vector in each cell (i, j) of its label and length that may hold a pair with it."""
    spark = ws.spark
    turn = Window.partitionBy("dim").orderBy("id", "k2")
    some = distinct.select("dim", "vec", F.row_number().over(turn).alias("turn")).where(F.col("turn") <= PIVOT_SAMPLE).orderBy("dim", "turn").collect()  # PIVOT_SAMPLE rows of a length
    pivots = {d: _pivots(_unit([bytes(r["vec"]) for r in some if r["dim"] == d])) for d in {r["dim"] for r in some}}
    apart = [(d, a, b, float(x)) for d, p in pivots.items() for a in range(len(p)) for b, x in enumerate(np.sqrt(((p - p[a]) ** 2).sum(1)))]
    apart = spark.createDataFrame(apart, "dim int, pivot int, other int, apart double")
    near = ws.stash(distinct.mapInArrow(_assign(spark.sparkContext.broadcast(pivots)), "label long, dim int, id long, k2 long, stand long, many long, vec binary, pivot int, far double"), "assigned")
    group = ["label", "dim"]
    balls = near.groupBy(*group, "pivot").agg(F.count("*").alias("m"), F.max("far").alias("radius"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*group).orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    balls = ws.stash(balls.withColumn("start", before), "balls")
    # Rows of balls, PIVOTS at most for a label and length.
    other = balls.select(*group, F.col("pivot").alias("other"), F.col("radius").alias("other_radius"), F.expr(f"sequence(start div {BLOCK}, (start + m - 1) div {BLOCK})").alias("blocks"))
    gap = F.col("apart") - F.col("other_radius") - (2 - 2 * cosine) ** 0.5 - 1e-9
    meet = balls.join(other, group).join(F.broadcast(apart), ["dim", "pivot", "other"]).withColumn("gap", gap).where(F.col("gap") <= F.col("radius"))
    meet = meet.groupBy(*group, "pivot", "start", "m").agg(F.collect_list(F.struct("gap", "blocks")).alias("reach"))
    others = F.array_distinct(F.flatten(F.transform(F.filter("reach", lambda x: x["gap"] <= F.col("far")), lambda x: x["blocks"])))
    place = F.col("start") + F.floor(F.shiftrightunsigned(F.xxhash64("id", "k2"), 1) / F.lit(2.0**63) * F.col("m")).cast("long")
    block = F.expr(f"place div {BLOCK}")
    dealt = near.join(meet, [*group, "pivot"]).withColumn("place", F.least(place, F.col("start") + F.col("m") - 1)).withColumn("block", block)
    dealt = dealt.select(F.col("label").alias("g1"), F.col("dim").cast("long").alias("g2"), "id", "k2", "many", "vec", "block", F.explode(others).alias("other"))
    return dealt.select("g1", "g2", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "k2", "many", "vec", "block")


def collisions(a: np.ndarray, b: np.ndarray | None, width: float) -> np.ndarray:
    """For every pair of rows, on how many columns they differ by at most width. Without b, pairs within a, each in one of its two places."""
    count = np.zeros((len(a), len(a) if b is None else len(b)), np.uint8)
    for j in range(a.shape[1]):
        base = a[:, j] if b is None else b[:, j]
        order = np.argsort(base, kind="stable")
        line = base[order]
        if b is None:
            ends = np.searchsorted(line, line + width, "right")
            for k in range(len(line)):
                count[order[k], order[k + 1 : ends[k]]] += 1
        else:
            lo, hi = np.searchsorted(line, a[:, j] - width, "left"), np.searchsorted(line, a[:, j] + width, "right")
            for k in range(len(a)):
                count[k, order[lo[k] : hi[k]]] += 1
    return count + count.T if b is None else count


def _match(cosine: float, projections: int, seed: int):
    width = REACH * sqrt(2 - 2 * cosine)
    least = needed(projections)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in grouped(batches, ["g1", "g2", "i", "j"]):
            ids, many, block = (table.column(c).to_numpy() for c in ("id", "many", "block"))
            u = _unit(table.column("vec").to_pylist())
            line = u @ np.random.default_rng(seed).standard_normal((u.shape[1], projections))
            # The cell of a block with itself, or of two blocks.
            same = key[2] == key[3]
            a, b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(block == key[2]), np.flatnonzero(block == key[3]))
            if len(a) < 1 + same or not len(b):
                continue
            i, j = np.nonzero(collisions(line[a], None if same else line[b], width) >= least)
            if same:
                i, j = i[i < j], j[i < j]
            near = np.zeros(len(i), bool)
            step = max(1, HELD_NUMBERS // u.shape[1])
            for lo in range(0, len(i), step):
                s = slice(lo, lo + step)
                near[s] = np.einsum("ij,ij->i", u[a[i[s]]], u[b[j[s]]]) >= cosine
            i, j = a[i[near]], b[j[near]]
            if not len(i):
                continue
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, i, many[j])
            np.add.at(links, j, many[i])
            node, to = stars(ids[i], ids[j])
            keep = links > 0
            least_id = ids.copy()
            order = np.argsort(node)
            at = np.minimum(np.searchsorted(node[order], ids), len(node) - 1)
            hit = node[order][at] == ids
            least_id[hit] = to[order][at[hit]]
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(links[keep]), pa.array(least_id[keep])], ["id", "links", "to"])

    return run


@small_batches
def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, projections: int = PROJECTIONS, seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of vectors.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is at least `cosine`.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do those of
    different length, nor rows with a null id (their component and kept are null). n_links counts the other rows that a
    row links to; component_id is the smallest id reachable. Rows that repeat an id are vectors of their own: each gets
    the links and the component of its own vector. Equal vectors of a label are one vector with a count, so copies are never paired. Other columns are ignored.
    """
    spark: SparkSession = vectors.sparkSession
    ws = Workspace(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = ws.stash(rows.mapInArrow(_prepare, "id long, label long, dim int, vec binary, k1 long, k2 long"), "rows")
    # Equal vectors of a label are one, named by its key; the smallest id of its rows stands for it.
    distinct = rows.where("dim > 0").groupBy("label", "dim", F.col("k1"), "k2").agg(F.min("id").alias("stand"), F.count("*").alias("many"), F.first("vec").alias("vec"))
    distinct = ws.stash(distinct.select("label", "dim", F.col("k1").alias("id"), "k2", "stand", "many", "vec"), "distinct")
    cells = _deal(ws, distinct, cosine).repartition("g1", "g2", "i", "j").sortWithinPartitions("g1", "g2", "i", "j")
    found = ws.stash(cells.mapInArrow(_match(cosine, projections, seed), "id long, links long, to long"), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = connected_components(ws, found.select(F.col("id").alias("u"), F.col("to").alias("v")), "links")
    named = distinct.select("id", "stand").join(joined.withColumnRenamed("node", "id"), "id")
    least = named.groupBy("component").agg(F.min("stand").alias("least"))
    moved = named.join(least, "component").select("id", "least")
    state = distinct.select("id", "k2", "stand", "many").join(links, "id", "left").join(moved, "id", "left")
    state = state.select(F.col("id").alias("k1"), "k2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("least", "stand").alias("component_id"))
    out = rows.select("id", *(F.when(F.col("dim") > 0, F.col(c)).alias(c) for c in ("k1", "k2"))).join(state, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("id") == F.col("component_id"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of embeddings at cosine 0.93."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.other = l.x
), c AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), d AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN d ON d.x = v.vec_id
"""
