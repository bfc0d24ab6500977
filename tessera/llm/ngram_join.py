"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two sets with intersection * den >= num * union share a shingle in their prefixes, the first
n - ceil(num * n / den) + 1 of each in any one order of all shingles. The order here: shingles whose hash is below a
fixed share of the hash space come first, the rarest of these first, then all others by hash. So only that share has
to be counted over the corpus, and a prefix nearly always ends within it. Shingles that one set alone posts cannot join
and are never posted. What the prefix join and its filters leave is grouped into clusters of sets that may link;
each cluster is verified in blocks of bounded size, all pairs of a block in one matrix product.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Workspace, connected_components, grouped, slices, small_batches
from tessera.llm.text import blob, shingle_sets

#: Hash ranges of the suffix filter: enough to tell unlike sets of up to about a thousand shingles apart.
BINS = 64
#: Sets and shingles in a block, at most about.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
#: Posting lists up to this long are joined pair by pair; longer ones by what can be reached from each set.
PAIR_LIST = 64
#: Posting lists up to this long stay in one task; longer ones are cut into runs of like set size.
SPREAD = 1 << 14
#: Postings held at a time by a task that joins them.
HELD_POSTINGS = 1 << 17
#: Sets that stand for a component when blocks of one cluster meet; of a list cut into runs, about so many are in each run.
DELEGATES = 16
#: Words of 64 bits, at most, of the table by which texts outside all clusters are mostly left where they are (16 bytes a word).
FILTER_WORDS = 1 << 18


def _sketch(n: int, num: int, den: int, cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, sent, bins, kept = [], [], [], []
            sets = list(shingle_sets(*blob(batch.column("text")), n))
            for g in sets:
                m = len(g)
                prefix = m - -(-num * m // den) + 1 if m else 0
                e = max(int(np.searchsorted(g, cut)), prefix)
                sizes.append(m)
                sent.append(e)
                bins.append(np.bincount(g & (BINS - 1), minlength=BINS))
                kept.append(g[:e])
            s = _key(sets)
            off = np.concatenate([[0], np.cumsum(sent)]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(kept)))
            hist = pa.ListArray.from_arrays(pa.array(np.arange(0, BINS * len(sizes) + 1, BINS, dtype=np.int32)), pa.array(np.concatenate(bins).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int32()), pa.array(sent, pa.int32()), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), hist, grams], ["id", "n", "e", "s1", "s2", "hist", "grams"])

    return run


def _key(sets: list[np.ndarray]) -> np.ndarray:
    """(s1, s2) of each set: equal sets have equal keys."""
    return np.frombuffer(b"".join(hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in sets), np.int64).reshape(-1, 2)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(*blob(batch.column("text")), n))
            yield pa.RecordBatch.from_arrays([pa.array(_key(sets)[:, 0].copy()), pa.array([g.tobytes() for g in sets], pa.binary())], ["id", "grams"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None, width: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs of sorted distinct arrays; within left if there is no right."""
    every = left + (right or [])
    values, column, count = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    shared = count > 1
    name = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], name[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    k = len(left)
    total = np.zeros((k, len(right) if right else k), np.float64)
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(every), width), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        total += m[:k] @ (m[k:] if right else m).T
    return total.astype(np.int64)


def components(links: np.ndarray) -> np.ndarray:
    """Component of each node of a symmetric boolean matrix, named by its first node."""
    k = len(links)
    found = np.full(k, -1)
    for i in range(k):
        if found[i] < 0:
            front = np.array([i])
            found[i] = i
            while len(front):
                new = np.flatnonzero(links[front].any(0) & (found < 0))
                found[new] = i
                front = new
    return found


def _linked(sizes_a: np.ndarray, sizes_b: np.ndarray, both: np.ndarray, num: int, den: int) -> np.ndarray:
    return (num + den) * both >= num * (sizes_a[:, None] + sizes_b[None, :])


def _verify(num: int, den: int, keys: list[str]):
    """For each block the smaller name that every set's label gets, by links within the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in grouped(batches, keys):
            ids = table.column("id").to_numpy()
            label = table.column("label").to_numpy()
            sets = [np.frombuffer(x, np.int64) for x in table.column("grams").to_pylist()]
            if len(ids) > 1:
                sizes = np.array([len(x) for x in sets])
                links = _linked(sizes, sizes, overlaps(sets), num, den)
                links |= label[:, None] == label[None, :]
                of = components(links)
                least = np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(least, of, label)
                to = least[of]
            else:
                to = label
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label), pa.array(to)], ["id", "label", "to"])

    return run


def _verify_across(num: int, den: int, keys: list[str]):
    """Links (u, v) of labels between the two sides of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in grouped(batches, keys):
            side, label = table.column("side").to_numpy(), table.column("label").to_numpy()
            sets = [np.frombuffer(x, np.int64) for x in table.column("grams").to_pylist()]
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(a) and len(b):
                left, right = [sets[i] for i in a], [sets[i] for i in b]
                both = overlaps(left, right)
                links = _linked(np.array([len(x) for x in left]), np.array([len(x) for x in right]), both, num, den)
                i, j = np.nonzero(links & (label[a][:, None] != label[b][None, :]))
                pairs = np.unique(np.stack([label[a][i], label[b][j]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

    return run


def _postings(ws: Workspace, texts: DataFrame, num: int, den: int, cut: int) -> DataFrame:
    """(id, n, hist, g, pos): the prefix shingles that two or more sets may share."""
    one = texts.select("id", F.explode("grams").alias("g"))
    often = one.groupBy("g").count().where("count > 1")
    first = F.col("g") < cut
    shared = one.join(often, "g").select("id", F.struct((~first).alias("late"), F.when(first, F.col("count")).otherwise(0).alias("df"), "g").alias("x"))
    lists = shared.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    prefix = F.expr(f"n - (({num}L * n + {den - 1}) div {den}) + 1")
    alone = F.col("e") - F.size("x")
    rows = lists.join(texts.select("id", "n", "e", "hist"), "id").withColumn("alone", alone).withColumn("prefix", prefix).where("prefix > alone")
    rows = rows.select("id", "n", "hist", (F.col("e") > F.col("prefix")).alias("exact"), "alone", F.posexplode(F.expr("slice(x, 1, CAST(prefix - alone AS INT))")).alias("k", "x"))
    # Where the prefix ends beyond the counted share, the place among the posted ones is a lower bound of the true one.
    pos = (F.col("k") + F.when(F.col("exact"), F.col("alone")).otherwise(0)).cast("int")
    return ws.stash(rows.select("id", "n", "hist", F.col("x.g").alias("g"), pos.alias("pos")), "postings")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) as links of each end to the smallest of its component."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(names))
    while len(a):
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (least[least] != least).any():
            least = least[least]
        on = least[a] != least[b]
        a, b = a[on], b[on]
    out = least != np.arange(len(names))
    return names[out], names[least[out]]


def _alike(total: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Suffix filter: whether sets of so many shingles in total share enough if each hash range shares all that it can."""
    return (num + den) * np.minimum(a, b).sum(1, dtype=np.int64) >= num * total


def reached(n: np.ndarray, left: np.ndarray, hist: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set of one list, ascending by size n, the first one of those that it hangs together with by pairs that pass the filters.

    What has been reached is not looked at again, so a list of near copies takes about one pass.
    """
    to = np.arange(len(n))
    free, fn, fl, fh = to.copy(), n, left, hist
    while len(free) > 1:
        seed = free[0]
        free, fn, fl, fh = free[1:], fn[1:], fl[1:], fh[1:]
        front = [seed]
        while front and len(free):
            i = front.pop()
            a, b = np.searchsorted(fn, [-(-num * n[i] // den), n[i] * den // num + 1])
            total = fn[a:b] + n[i]
            good = (np.minimum(fl[a:b], left[i]) * (num + den) >= num * total) & _alike(total, fh[a:b], hist[i], num, den)
            if good.any():
                hit = free[a:b][good]
                to[hit] = seed
                front += hit.tolist()
                rest = np.ones(len(free), bool)
                rest[a:b] = ~good
                free, fn, fl, fh = free[rest], fn[rest], fl[rest], fh[rest]
    return to


def apart(n: np.ndarray, left: np.ndarray, hist: np.ndarray, label: np.ndarray, k: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) of labels: of the first k sets with the others, which ascend by size n, by pairs that pass the filters.

    Pairs that hang together by now are not looked at.
    """
    names, of = np.unique(label, return_inverse=True)
    to = np.arange(len(names))
    tn, tl, th, tof = n[k:], left[k:], hist[k:], of[k:]
    for i in range(k):
        a, b = np.searchsorted(tn, [-(-num * n[i] // den), n[i] * den // num + 1])
        mine = to[of[i]]
        j = a + np.flatnonzero(to[tof[a:b]] != mine)
        j = j[np.minimum(tl[j], left[i]) * (num + den) >= num * (tn[j] + n[i])]
        j = j[_alike(tn[j] + n[i], th[j], hist[i], num, den)]
        if len(j):
            met = np.append(np.unique(to[tof[j]]), mine)
            to[np.isin(to, met)] = met.min()
    moved = to != np.arange(len(names))
    return names[moved], names[to[moved]]


def _columns(table: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Columns of postings, and hist with a row for each."""
    rows = {c: table.column(c).to_numpy().astype(np.int64) for c in names}
    rows["hist"] = table.column("hist").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    return rows


def _near(num: int, den: int):
    """Links (u, v) within the lists of postings that are sorted by list and set size.

    A short list is joined pair by pair, and a longer one by what can be reached: length, positional and suffix filter.
    """

    def block(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        g, n, left, ids = rows["g"], rows["n"], rows["n"] - rows["pos"], rows["id"]
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(start, append=len(g))
        us, vs = [], []
        # Rows of one list stand side by side: all pairs at once, by how far they are apart.
        i = np.flatnonzero(np.repeat(size <= PAIR_LIST, size))
        d = 0
        while len(i):
            d += 1
            i = i[i + d < len(g)]
            i = i[g[i + d] == g[i]]
            j = i + d
            total = num * (n[i] + n[j])
            good = (n[i] * den >= num * n[j]) & (np.minimum(left[i], left[j]) * (num + den) >= total) & (ids[i] != ids[j])
            a, b = i[good], j[good]
            good = _alike(n[a] + n[b], rows["hist"][a], rows["hist"][b], num, den)
            us.append(ids[a[good]])
            vs.append(ids[b[good]])
        for k in np.flatnonzero(size > PAIR_LIST):
            one = slice(start[k], start[k] + size[k])
            us.append(ids[one][reached(n[one], left[one], rows["hist"][one], num, den)])
            vs.append(ids[one])
        return (np.concatenate(us), np.concatenate(vs)) if us else (ids[:0], ids[:0])

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        u, v = stars(*block(_columns(table, ("g", "n", "pos", "id"))))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= HELD_POSTINGS:
                table = pa.Table.from_batches(held)
                g = table.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield from work(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    count = sum(x.num_rows for x in held)
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _near_across(num: int, den: int):
    """Links (u, v) of labels between the two sides of each pair of runs, sorted by side and set size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in grouped(batches, ["g", "a", "b"]):
            rows = _columns(table, ("side", "n", "pos", "label"))
            k = int(np.searchsorted(rows["side"], 1))
            if 0 < k < table.num_rows:
                u, v = apart(rows["n"], rows["n"] - rows["pos"], rows["hist"], rows["label"], k, num, den)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _runs(ws: Workspace, postings: DataFrame, big: DataFrame) -> DataFrame:
    """(g, n, hist, id, pos, count, run): big lists cut into runs of like size, of at most SPREAD postings and ascending by n."""
    room = max(1, SPREAD // 4)
    common = postings.join(F.broadcast(big), "g")
    sizes = common.groupBy("g", "n").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("g").orderBy("n")) - F.col("m")
    # Sets of one size beyond what a run has room for are dealt to several.
    place = sizes.select("g", "n", F.floor(before / room).alias("base"), F.ceil(F.col("m") / room).alias("runs"))
    return ws.stash(common.join(place, ["g", "n"]).select("g", "n", "hist", "id", "pos", "count", (F.col("base") + F.pmod(F.xxhash64(F.lit(5), "id"), F.col("runs"))).alias("run")), "runs")


def _candidates(ws: Workspace, postings: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) whose components hold every pair that may link.

    Lists are dealt by ranges of shingles; big ones are cut into runs, each a list of its own, to which a few sets of the whole
    list are added, so that alike ones hang together across runs. What is then outside a big list's largest component meets
    the other runs within the length bound.
    """
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    near = lambda rows: ws.stash(rows.repartitionByRange(parts, "g").sortWithinPartitions("g", "n", "id").mapInArrow(_near(num, den), "u long, v long"), "near")
    lists = postings.select("id", "n", "hist", "g", "pos")
    counts = postings.groupBy("g").count()
    if (counts.agg(F.max("count")).first()[0] or 0) <= SPREAD:
        return near(lists)
    # At most one row for each SPREAD postings.
    big = ws.stash(counts.where(F.col("count") > SPREAD), "big")
    runs = _runs(ws, postings, big)
    last = runs.groupBy("g").agg(F.max("run").alias("last"))
    some = runs.where(F.pmod(F.xxhash64(F.lit(6), "id"), F.ceil(F.col("count") / DELEGATES)) == 0).drop("run")
    some = some.join(F.broadcast(last), "g").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    cut = runs.select("id", "n", "hist", "g", "pos", "run").union(some.select("id", "n", "hist", "g", "pos", "run"))
    links = near(lists.join(F.broadcast(big), "g", "left_anti").select(lists.columns).union(cut.select("id", "n", "hist", F.xxhash64("g", "run").alias("g"), "pos")))
    whole = connected_components(ws, links, "near")
    label = F.coalesce("component", "id")
    rows = ws.stash(runs.join(whole, runs["id"] == whole["node"], "left").select("g", "run", "id", "n", "hist", "pos", label.alias("label")), "labelled")
    held = rows.groupBy("g", "label").count()
    main = held.groupBy("g").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rows = rows.join(F.broadcast(main), "g").withColumn("away", F.col("label") != F.col("main"))
    bounds = lambda df, k: df.groupBy("g", F.col("run").alias(k)).agg(F.min("n").alias(f"low_{k}"), F.max("n").alias(f"high_{k}"))
    pairs = bounds(rows.where("away"), "a").join(bounds(rows, "b"), "g").where(f"high_a * {den} >= low_b * {num} AND high_b * {den} >= low_a * {num}")
    pairs = ws.stash(pairs.select("g", "a", "b"), "run-pairs")
    cols = ["g", "a", "b", "n", "hist", "pos", "label"]
    ask = rows.where("away").withColumnRenamed("run", "a").join(pairs, ["g", "a"]).select(*cols, F.lit(0).alias("side"))
    # Two sets that are both away meet in one of the two pairs of their runs.
    tell = rows.withColumnRenamed("run", "b").join(pairs, ["g", "b"]).where("NOT away OR b >= a").select(*cols, F.lit(1).alias("side"))
    met = ask.union(tell).repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "side", "n")
    across = ws.stash(met.mapInArrow(_near_across(num, den), "u long, v long"), "near-across")
    return whole.select(F.col("node").alias("u"), F.col("component").alias("v")).union(across)


def _blocks(m, w):
    """How many blocks m sets of w shingles take."""
    return F.greatest(F.ceil(m / BLOCK_SETS), F.ceil(w / BLOCK_SHINGLES)).cast("int")


def _resolve(ws: Workspace, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, label): the components of all sets (id, cluster, blocks, grams)."""
    spread = lambda c, n, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.col(n)).cast("int")
    dealt = sets.select("cluster", spread("id", "blocks", 0).alias("b"), "id", F.col("id").alias("label"), "blocks", "grams")
    dealt = dealt.repartition("cluster", "b").sortWithinPartitions("cluster", "b")
    labels = ws.stash(dealt.mapInArrow(_verify(num, den, ["cluster", "b"]), "id long, label long, to long").select("id", F.col("to").alias("label")), "labels0")
    large = sets.where("blocks > 1")
    if large.select("id").isEmpty():
        return labels
    large = ws.stash(large, "large")
    now = ws.stash(large.select("id", "cluster", "blocks", (F.length("grams") / 8).cast("long").alias("n")).join(labels, "id"), "large-labels0")
    k, apart = 0, now.select("cluster", "label").distinct().count()
    while True:
        # A few delegates of every component meet, and merge what links.
        k += 1
        open_ = now.groupBy("cluster").agg((F.min("label") < F.max("label")).alias("open")).where("open").select("cluster")
        turn = Window.partitionBy("cluster", "label").orderBy(F.xxhash64(F.lit(k), "id"), "id")
        some = now.join(open_, "cluster").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= DELEGATES).select("id", "cluster", "label", "n")
        some = ws.stash(some, f"delegates{k}")
        rooms = some.groupBy("cluster").agg(_blocks(F.count("*"), F.sum("n")).alias("rooms"))
        most = rooms.agg(F.max("rooms")).first()[0]
        if most is None:
            break
        met = some.join(rooms, "cluster").withColumn("b", spread("label", "rooms", k)).join(large.select("id", "grams"), "id")
        met = met.repartition("cluster", "b").sortWithinPartitions("cluster", "b").select("cluster", "b", "id", "label", "grams")
        merged = met.mapInArrow(_verify(num, den, ["cluster", "b"]), "id long, label long, to long").select("label", "to").distinct()
        now = ws.stash(now.join(merged, "label", "left").select("id", "cluster", "blocks", "n", F.coalesce("to", "label").alias("label")), f"large-labels{k}")
        # Rounds go on while they halve what is apart, so there are few; the rest is compared in full below.
        after = now.select("cluster", "label").distinct().count()
        if most == 1 or 2 * after > apart:
            break
        apart = after
    # What is still apart: all sets outside a cluster's largest component, against all of the cluster.
    held = now.groupBy("cluster", "label").agg(F.count("*").alias("held"))
    main = held.groupBy("cluster").agg(F.max_by("label", F.struct("held", "label")).alias("main"))
    away = now.join(main, "cluster").where("label <> main").drop("main")
    queries = away.groupBy("cluster").agg(_blocks(F.count("*"), F.sum("n")).alias("rows"))
    ask = away.join(queries, "cluster").select("cluster", spread("id", "rows", 1).alias("r"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"), "id", "label", F.lit(0).alias("side"))
    tell = now.join(queries, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), spread("id", "blocks", 2).alias("c"), "id", "label", F.lit(1).alias("side"))
    met = ask.union(tell).join(large.select("id", "grams"), "id").repartition("cluster", "r", "c").sortWithinPartitions("cluster", "r", "c")
    links = met.select("cluster", "r", "c", "id", "label", "side", "grams").mapInArrow(_verify_across(num, den, ["cluster", "r", "c"]), "u long, v long")
    last = connected_components(ws, links, "across")
    now = now.join(last, now["label"] == last["node"], "left").select("id", F.coalesce("component", "label").alias("better"))
    return labels.join(now, "id", "left").select("id", F.coalesce("better", "label").alias("label"))


def _members(ws: Workspace, texts: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster, blocks): the sets of every candidate cluster, and in how many blocks it is verified."""
    clusters = connected_components(ws, links, "candidates").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    sized = clusters.join(texts.select("id", "n"), "id").groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    return ws.stash(clusters.join(sized.select("cluster", _blocks(F.col("m"), F.col("w")).alias("blocks")), "cluster").select("id", "cluster", "blocks"), "member")


def _member_sets(ws: Workspace, rows: DataFrame, texts: DataFrame, member: DataFrame, n: int) -> DataFrame:
    """(id, cluster, blocks, grams). Texts are read again where they are, and only the sets of members are dealt.

    A table of bits, FILTER_WORDS words at most whatever the corpus, tells by the document which texts to look at: no member is
    left out, and what else it lets through goes in the join behind.
    """
    bit = lambda c: F.pmod(F.xxhash64(F.lit(41), c), F.lit(FILTER_WORDS * 64))
    chosen = member.join(texts.select("id", "stand"), "id").select(bit("stand").alias("bit"))
    words = chosen.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, CAST(bit & 63 AS INT))").alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits"))
    asked = rows.where("id IS NOT NULL").withColumn("bit", bit("id")).withColumn("word", F.shiftright("bit", 6))
    some = asked.join(F.broadcast(words), "word").where(F.expr("(bits & shiftleft(1L, CAST(bit & 63 AS INT))) <> 0")).select("text")
    sets = some.mapInArrow(_sets(n), "id long, grams binary")
    return sets.join(member.hint("merge"), "id").groupBy("id", "cluster", "blocks").agg(F.first("grams").alias("grams"))


@small_batches
def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100, share: float | None = None) -> DataFrame:
    """(id, n_shingles, component_id), one row for each row of docs.

    A document's set: the distinct n-word shingles of the text with A-Z lower-cased, words being runs without ASCII
    white space; with fewer words, the whole sequence as one; without words, or null, empty. Documents link when
    den * intersection >= num * union, empty ones with nothing. component_id: the smallest id reachable by links.
    Rows with a null id link with nothing and get a null component. Each row counts with its own text: rows that repeat an id
    and text get the same result, and those of one id with different texts each the component of their text, which may
    differ. Shingles are compared by 64-bit hashes, and sets told apart by them. Other columns are ignored.
    share: of the hash space, the part whose shingles are counted.
    """
    spark: SparkSession = docs.sparkSession
    ws = Workspace(spark, "ngrams")
    share = min(1.0, share if share is not None else 1 - num / den + 0.06)
    cut = min(-(2**63) + int(share * 2**64), 2**63 - 1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    sketch = ws.stash(rows.mapInArrow(_sketch(n, num, den, cut), "id long, n int, e int, s1 long, s2 long, hist array<int>, grams array<long>"), "sketch")
    # Equal sets are one, named by its key; the smallest id of its rows stands for it.
    known = sketch.where("n > 0 AND id IS NOT NULL")
    first = F.min_by(F.struct("id", "n", "e", "hist", "grams"), "id").alias("r")
    texts = ws.stash(known.groupBy("s1", "s2").agg(first).select(F.col("s1").alias("id"), "s2", F.col("r.id").alias("stand"), "r.n", "r.e", "r.hist", "r.grams"), "texts")
    links = _candidates(ws, _postings(ws, texts, num, den, cut), num, den)
    member = _members(ws, texts, links)
    ws.drop("postings", "near", "runs", "labelled", "near-across")
    sets = ws.stash(_member_sets(ws, rows, texts, member, n), "sets")
    labels = _resolve(ws, sets, num, den)
    # Of each component the smallest id.
    named = labels.join(texts.select("id", "stand"), "id")
    least = named.groupBy("label").agg(F.min("stand").alias("least"))
    moved = named.join(least, "label").select(F.col("id").alias("s1"), "least")
    full = sketch.select("id", "n", *(F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col(c)).alias(c) for c in ("s1", "s2")))
    full = full.join(texts.select(F.col("id").alias("s1"), "s2", "stand"), ["s1", "s2"], "left").join(moved, "s1", "left")
    return full.select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "stand", "id").alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by 4-word shingles and Jaccard similarity 0.85."""
    out = ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumnRenamed("id", "doc_id")


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS i
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM common WHERE 100 * i >= 85 * (nx + ny - i)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r ON r.doc_id = s.doc_id
"""
