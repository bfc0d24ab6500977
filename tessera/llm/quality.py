"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Every word has a sparse random index vector; its word vector sums the index vectors of its neighbours over all of the
corpus. All words are counted over the corpus; the OWN most frequent have vectors of their own, and the others, each too rare
to say much alone, share SHARED vectors by hash, so the table has a bounded size and no word is left out. A document is
pooled as the mean and the deviation of the word vectors of its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import Workspace, free_name, slices, small_batches
from tessera.llm.text import blob, splitmix, tokens

#: Words with a vector of their own, at most, and vectors that the others share.
OWN, SHARED = 1 << 15, 1 << 13
#: Dimensions of a word vector, non-zero places of an index vector, neighbours on each side.
DIM, PLACES, REACH = 64, 4, 2
#: The table is summed in so many ranges of slots.
RANGES = 64
#: Words whose counts a task holds.
HELD_WORDS = 1 << 20
#: Frequencies are told apart in steps of an eighth of their logarithm to base 2.
_STEPS = 8
#: Labelled documents that the network is fitted on, at most; the rest only gets scores.
SAMPLE = 20_000
HIDDEN = 32

#: Letters (and all bytes beyond ASCII), digits and other signs are words of their own.
_KINDS = np.full(256, 3, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = 0
_KINDS[48:58] = 2
_KINDS[65:91] = _KINDS[97:123] = 1
_KINDS[128:] = 1
_CAPITAL = np.zeros(256, np.int32)
_CAPITAL[65:91] = 1
#: The first slots are for word shapes: a number, a word in capitals, a word that repeats the last or the one before it.
_NUMBER, _CAPITALS, _AGAIN, _AGAIN2, _SHAPES = 0, 1, 2, 3, 4


def coded_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its shape or -1, and the first word of each row (and of the end)."""
    h, start, first = tokens(buf, off, _KINDS)
    shape = np.full(len(h), -1, np.int64)
    if not len(h):
        return h, shape, first
    kind = _KINDS[buf[start]]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    word = kind == 1
    for back, name in ((2, _AGAIN2), (1, _AGAIN)):
        same = np.zeros(len(h), bool)
        same[back:] = (h[back:] == h[:-back]) & (row[back:] == row[:-back])
        shape[same & word] = name
    # Words of two capitals or more: of those that begin with two, all bytes up to the white space behind.
    some = np.flatnonzero(_CAPITAL[buf[start]] & _CAPITAL[buf[np.minimum(start + 1, int(off[-1]) - 1)]] & (np.diff(start, append=int(off[-1])) > 1))
    if len(some):
        size = np.append(start, off[-1])[some + 1] - start[some]
        lead = np.cumsum(size) - size
        held = buf[np.repeat(start[some] - lead, size) + np.arange(int(size.sum()))]
        shape[some[np.add.reduceat(_CAPITAL[held] | (_KINDS[held] == 0), lead) == size]] = _CAPITALS
    shape[kind == 2] = _NUMBER
    return h, shape, first


class Vocabulary:
    """Slots of words: shapes first, then a slot for each frequent word, then those that all others share by hash."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words.astype(np.uint64))
        self.size = _SHAPES + len(self.words) + SHARED
        # Hashes are even, so few words have the same first 16 bits: where those with each begin, and how many there are at most.
        self.first = np.searchsorted(self.words, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        self.first = np.append(self.first, len(self.words))
        self.most = int(np.diff(self.first).max())

    def slots(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each word, and the first word of each row (and of the end)."""
        h, shape, first = coded_words(buf, off)
        slot = (h % np.uint64(SHARED)).astype(np.int64) + _SHAPES + len(self.words)
        bucket = (h >> np.uint64(48)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < end)
        for _ in range(self.most):
            hit = self.words[at[left]] == h[left]
            slot[left[hit]] = at[left[hit]] + _SHAPES
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return np.where(shape >= 0, shape, slot), first

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and signs of the index vectors, (size, PLACES) each."""
        r = splitmix(self.size * PLACES, 11).reshape(self.size, PLACES)
        return (r % np.uint64(DIM)).astype(np.int64), np.where((r >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a task's documents, given out whenever HELD_WORDS of them are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        word, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in held)]), return_inverse=True)
        return word, np.bincount(at, np.concatenate([np.zeros(0), *(n for _, n in held)]), len(word)).astype(np.int64)

    def out(word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in slices(batches):
        h, shape, _ = coded_words(*blob(batch.column("text")))
        held.append(np.unique(h[shape < 0], return_counts=True))
        if sum(len(w) for w, _ in held) >= HELD_WORDS:
            held = [merge()]
            # Halfway to the bound it pays no more to merge.
            if 2 * len(held[0][0]) >= HELD_WORDS:
                yield out(*held.pop())
    yield out(*merge())


def frequent_words(ws: Workspace, texts: DataFrame, most: int = OWN) -> Vocabulary:
    """The words of all of texts (text binary) that are at least as frequent as the rarest step of which `most` have room."""
    counts = ws.stash(texts.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    step = F.floor(F.log2("n") * _STEPS).cast("int")
    held = {r["step"]: r["words"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}  # at most 63 * _STEPS rows
    least, room = None, most
    for k in sorted(held, reverse=True):
        room -= held[k]
        if room < 0:
            break
        least = k
    own = [] if least is None else [r["word"] for r in counts.where(step >= least).select("word").collect()]  # at most `most` rows
    ws.drop("words")
    return Vocabulary(np.array(own, np.int64).view(np.uint64))


def _pack(slot: np.ndarray, sums: np.ndarray) -> bytes:
    return zlib.compress(slot.astype(np.int32).tobytes() + sums.astype(np.int64).tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    m = len(raw) // (4 + 8 * (DIM + 1))
    return np.frombuffer(raw, np.int32, m), np.frombuffer(raw, np.int64, offset=4 * m).reshape(m, DIM + 1)


def _gather(shared):
    """Sums over a task's documents: for each range of slots, those in use with their word vectors and word counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        place, sign = words.index()
        # Places with a negative sign come behind the others, so that plain counts tell both.
        code = place + DIM * (sign < 0)
        total = np.zeros((words.size, DIM + 1), np.int64)
        name_of = np.zeros(words.size, np.int64)
        for batch in slices(batches):
            slot, first = words.slots(*blob(batch.column("text")))
            if not len(slot):
                continue
            # Counts of the batch's own slots, then added up: the table is large, and a batch uses little of it.
            count = np.bincount(slot, minlength=words.size)
            names = np.flatnonzero(count)
            name_of[names] = np.arange(len(names))
            base = (name_of[slot] * (2 * DIM))[:, None]
            codes = code[slot]
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            hits = []
            for d in range(1, REACH + 1):
                near = row[d:] == row[:-d]
                hits += [(base[:-d][near] + codes[d:][near]).ravel(), (base[d:][near] + codes[:-d][near]).ravel()]
            sums = np.bincount(np.concatenate(hits), minlength=len(names) * 2 * DIM)
            sums = sums.reshape(-1, 2, DIM)
            total[names, :DIM] += sums[:, 0] - sums[:, 1]
            total[:, DIM] += count
        used = np.flatnonzero(total[:, DIM])
        range_ = used * RANGES // words.size
        cuts = np.searchsorted(range_, np.arange(RANGES + 1))
        some = [k for k in range(RANGES) if cuts[k] < cuts[k + 1]]
        packed = [_pack(used[cuts[k] : cuts[k + 1]], total[used[cuts[k] : cuts[k + 1]]]) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["range", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up what stands side by side for one range."""
    now, slot, total = None, np.zeros(0, np.int32), np.zeros((0, DIM + 1), np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_pack(slot, total)], pa.binary())], ["range", "sums"])

    for batch in batches:
        for key, data in zip(batch.column("range").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    yield out()
                now, slot, total = key, slot[:0], total[:0]
            more, sums = _unpack(data)
            both, at = np.unique(np.concatenate([slot, more]), return_inverse=True)
            grown = np.zeros((len(both), DIM + 1), np.int64)
            grown[at[: len(slot)]] = total
            grown[at[len(slot) :]] += sums
            slot, total = both, grown
    if now is not None:
        yield out()


def word_vectors(texts: DataFrame, words: Vocabulary) -> np.ndarray:
    """(words.size, DIM) standardised word vectors over all rows of texts (text binary). The table's size is bounded."""
    shared = texts.sparkSession.sparkContext.broadcast(words)
    parts = texts.select("text").mapInArrow(_gather(shared), "range int, sums binary")
    # Two steps: a range of a large corpus has a part from every task. Then a row for each range comes to the driver.
    parts = parts.withColumn("salt", F.spark_partition_id() % 16).repartition("range", "salt").sortWithinPartitions("range", "salt")
    some = parts.select("range", "sums").mapInArrow(_add, "range int, sums binary").repartition("range").sortWithinPartitions("range")
    v, count = np.zeros((words.size, DIM), np.float32), np.zeros(words.size)
    for row in some.mapInArrow(_add, "range int, sums binary").toLocalIterator():
        slot, sums = _unpack(bytes(row["sums"]))
        v[slot], count[slot] = sums[:, :DIM] / sums[:, DIM:], sums[:, DIM]
    shared.unpersist()
    used = count > 0
    if used.any():
        weight = np.sqrt(count[used])[:, None]
        mean = (v[used] * weight).sum(0) / weight.sum()
        dev = np.sqrt(((v[used] - mean) ** 2 * weight).sum(0) / weight.sum()) + 1e-9
        v[used] = ((v[used] - mean) / dev).clip(-8, 8)
    return v


def pool(vectors: np.ndarray, slot: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, 2 * DIM + 5): mean and deviation of each row's word vectors, the shares of the word shapes, and the log length."""
    rows = len(first) - 1
    out = np.zeros((rows, 2 * DIM + _SHAPES + 1), np.float32)
    for r in range(rows):
        s = slot[first[r] : first[r + 1]]
        if len(s):
            used, n = np.unique(s, return_counts=True)
            w = n.astype(np.float32) / len(s)
            v = vectors[used]
            mean = w @ v
            out[r, :DIM] = mean
            out[r, DIM : 2 * DIM] = np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))
            shapes = used < _SHAPES
            out[r, 2 * DIM + used[shapes]] = n[shapes] / len(s)
            out[r, -1] = np.log1p(len(s)) / 10
    return out


def _pool(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors = shared.value
        for batch in slices(batches):
            x = pool(vectors, *words.slots(*blob(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "pooled"])

    return run


@dataclass
class Network:
    """Two layers over standardised inputs; score() divides the output by the temperature."""

    mean: np.ndarray
    dev: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def _out(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w1 + self.b1)
        return h, h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self._out((x - self.mean) / self.dev)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seed: int = 0, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4) -> Network:
        """Adam on the logistic loss of four rows in five; the temperature is the one with the least loss on the fifth."""
        rng = np.random.default_rng(seed)
        mean, dev = x.mean(0), x.std(0) + 1e-4
        net = cls(mean, dev, rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), 0.0)
        x = (x - mean) / dev
        held = rng.permutation(len(x)) < len(x) // 5
        a, b = x[~held], y[~held]
        params = [net.w1, net.b1, net.w2, np.array([net.b2])]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(a))
            for lo in range(0, len(a), 64):
                i = order[lo : lo + 64]
                h = np.tanh(a[i] @ params[0] + params[1])
                g = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - b[i]) / len(i)
                back = g[:, None] * params[2] * (1 - h * h)
                grads = [a[i].T @ back + decay * params[0], back.sum(0), h.T @ g + decay * params[2], np.array([g.sum()])]
                t += 1
                step = rate * (1 - epoch / epochs)
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    params[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
        if held.any():
            z, target = net._out(x[held])[1], y[held]
            choices = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.mean(np.logaddexp(0, -(2 * target - 1) * z / c)) for c in choices]
            net.temperature = float(choices[int(np.argmin(loss))])
        return net


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches):
            x = np.frombuffer(b"".join(batch.column("pooled").to_pylist()), np.float32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(net.score(x) if len(x) else np.zeros(0), pa.float64())], ["id", "score"])

    return run


def _vectors(ws: Workspace, rows: DataFrame):
    words = frequent_words(ws, rows)
    return ws.spark.sparkContext.broadcast((words, word_vectors(rows, words)))


def pooled_documents(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pooled), written to the workspace; word vectors are of all rows of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    shared = _vectors(ws, rows)
    return ws.stash(rows.mapInArrow(_pool(shared), "id long, pooled binary"), "pooled")


def _sampled(labels: DataFrame, sample: int) -> DataFrame:
    """At most `sample` labelled ids, but for a chance of one in some ten thousand: those whose hash is below the share."""
    some = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    share = (sample - 4 * sample**0.5) / max(1, some.count())
    return some if share >= 1 else some.where(F.xxhash64(F.lit(5), "id") < int((2 * share - 1) * 2**63))


def fit_quality(pooled: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """A network for labels (id, label 0 or 1), from at most `sample` labelled rows, chosen by hash. With one label alone, or none, a constant score."""
    some = _sampled(labels, sample)
    got = pooled.where("id IS NOT NULL").join(F.broadcast(some), "id").groupBy("id").agg(F.min("pooled").alias("pooled"), F.max("label").alias("label")).orderBy("id").collect()
    if not got:
        return 0.5
    y = np.array([float(r["label"]) for r in got])
    if y.min() == y.max():
        return float(y[0])
    return Network.fit(np.stack([np.frombuffer(bytes(r["pooled"]), np.float32) for r in got]).astype(np.float64), y)


@small_batches
def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(id, score), one row for each row of docs: how likely label 1 is, 0 to 1.

    labels: (id, label 0 or 1) to learn from; null ids or labels are left out, and an id with both labels counts as 1.
    The score depends on the text alone. Null text counts as empty, which has no words and gets one score of its own.
    Rows may repeat; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "quality")
    pooled = pooled_documents(ws, docs, id_col, text_col)
    net = fit_quality(pooled, labels, sample)
    if isinstance(net, float):
        return pooled.select("id", F.lit(net).alias("score"))
    return pooled.mapInArrow(_score(ws.spark.sparkContext.broadcast(net)), "id long, score double")


def _keep(vectors, network, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (words, table), net = vectors.value, network.value
        for batch in slices(batches):
            score = net.score(pool(table, *words.slots(*blob(batch.column(name))))) if batch.num_rows else np.zeros(0)
            yield batch.select([k for k in range(batch.num_columns) if batch.schema.names[k] != name]).filter(pa.array(score >= 0.5))

    return run


@small_batches
def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """docs, with all its columns, without the rows that score_quality() scores below 0.5. Each row is decided where it is read."""
    ws = Workspace(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    shared = _vectors(ws, rows)
    some = _sampled(labels, sample)
    pooled = rows.join(F.broadcast(some), "id").select("id", "text").mapInArrow(_pool(shared), "id long, pooled binary")
    net = fit_quality(pooled, labels, sample)
    if isinstance(net, float):
        return docs if net >= 0.5 else docs.limit(0)
    name = free_name(docs, "text_bytes")
    return docs.withColumn(name, F.col(text_col).cast("binary")).mapInArrow(_keep(shared, ws.spark.sparkContext.broadcast(net), name), docs.schema)


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def learning_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels but for the held-out third."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(remainder("doc_id", 3) != 1).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    scores = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), learning_labels(spark, sf_dir))
    return scores.select(F.col("id").alias("doc_id"), F.coalesce(remainder("id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
