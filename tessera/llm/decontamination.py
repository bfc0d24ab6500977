"""Benchmark decontamination by greedy string tiling.

Documents that share a seed, `least` consecutive words, with a benchmark item are tiled against it: the longest
matching runs of words that are not yet covered are marked, found by running Karp-Rabin, until none of `least`
words is left. The share of the item's words under tiles, in whatever order these stand in the document, decides. An
item of fewer than `least` words is its own seed and tile.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import free_name, slices, small_batches
from tessera.llm.text import tokens, windows

#: Words of a seed, and of the shortest tile.
LEAST = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Benchmark words held at a time (16 bytes each, on the driver and in each worker).
BLOCK_WORDS = 4_000_000
#: A seed that more items than this have may be left out of the index.
COMMON = 8
#: Matches held at a time when a document is compared.
HELD_MATCHES = 1 << 20

_KINDS = np.zeros(256, np.uint8)
_KINDS[48:58] = _KINDS[65:91] = _KINDS[97:123] = 1
_KINDS[128:] = 1
#: Signs beyond ASCII that are not part of words.
_SIGNS = re.compile("[\u0080-©«-´¶-¹»-¿×÷ -⁯　-〄〈-〠＀-／：-＠]")
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    p = np.ones(n, np.uint64)
    if n > 1:
        p[1:] = np.multiply.accumulate(np.full(n - 1, base, np.uint64))
    return p


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (letters and digits) of texts, and the first word of each (and of the end)."""
    raw = []
    for t in texts:
        t = (t or "").lower()
        raw.append((t if t.isascii() else _SIGNS.sub(" ", t)).encode("utf-8", "replace"))
    off = np.cumsum([0, *map(len, raw)])
    # Signs separate words; the tokenizer cuts long texts at white space only, which is fine, as that separates too.
    h, _, first = tokens(np.frombuffer(b"".join(raw), np.uint8), off, _KINDS)
    return h, first


def _rolling(x: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hash of every s consecutive values, modulo 2**64."""
    m = len(x) - s + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    # A prefix sum with growing powers of the base, each window divided by the power it starts with.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _powers(len(x), _BASE), dtype=np.uint64)])
    return (sums[s:] - sums[:-s]) * _powers(m, pow(_BASE, -1, 1 << 64))


def tile(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, words) of greedy string tiling: again and again the longest match of words that
    no tile covers, the first in the item and then in the doc where several are as long."""
    tiles: list[tuple[int, int, int]] = []
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    s = max(least, len(item))
    while True:
        length, at_item, at_doc = _matches(item, doc, in_item, in_doc, s)
        order = np.lexsort((at_doc, at_item, -length))
        placed = False
        for n, i, j in zip(length[order].tolist(), at_item[order].tolist(), at_doc[order].tolist(), strict=True):
            if in_item[i : i + n].any() or in_doc[j : j + n].any():
                break  # what is left of it may still be longer than the next one: look again
            in_item[i : i + n] = in_doc[j : j + n] = True
            tiles.append((i, j, n))
            placed = True
        if placed:
            continue
        if s <= least:
            return tiles
        s = max(least, s // 2)


def _matches(item: np.ndarray, doc: np.ndarray, in_item: np.ndarray, in_doc: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, place in item and place in doc of all matches of at least s uncovered words that reach as far as they can to both sides."""
    free_i, free_d = _free(in_item, s), _free(in_doc, s)
    none = np.zeros(0, np.int64)
    if not len(free_i) or not len(free_d):
        return none, none, none
    hi, hd = _rolling(item, s)[free_i], _rolling(doc, s)[free_d]
    order = np.argsort(hi, kind="stable")
    lo, up = np.searchsorted(hi[order], hd, "left"), np.searchsorted(hi[order], hd, "right")
    some = np.flatnonzero(up > lo)
    many = (up - lo)[some]
    found = []
    for a, b in _spans(many, HELD_MATCHES):
        k, m = some[a:b], many[a:b]
        j = np.repeat(free_d[k], m)
        i = free_i[order[np.repeat(lo[k] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]]
        # One that goes on to the left is found where it begins.
        inner = (i > 0) & (j > 0)
        inner[inner] = (item[i[inner] - 1] == doc[j[inner] - 1]) & ~in_item[i[inner] - 1] & ~in_doc[j[inner] - 1]
        i, j = i[~inner], j[~inner]
        n = np.zeros(len(i), np.int64)
        on = np.arange(len(i))
        while len(on):
            x, y = i[on] + n[on], j[on] + n[on]
            on, x, y = (z[(x < len(item)) & (y < len(doc))] for z in (on, x, y))
            on = on[(item[x] == doc[y]) & ~in_item[x] & ~in_doc[y]]
            n[on] += 1
        found.append((n, i, j))
    n, i, j = (np.concatenate([none, *x]) for x in zip(*found, strict=True)) if found else (none, none, none)
    good = n >= s
    return n[good], i[good], j[good]


def _free(taken: np.ndarray, s: int) -> np.ndarray:
    if len(taken) < s:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(taken)])
    return np.flatnonzero(sums[s:] == sums[:-s])


class Items:
    """Benchmark items with an index of their seeds.

    All words of a tile are words of seeds that item and document share, so an item can be held only if its shared seeds
    cover the share `coverage` of its words. So seeds that many items have are left out of the index for as long as
    those left out cover less of an item than that: a document that holds the item has one of the others as well.
    """

    def __init__(self, ids: list[int], texts: list[str | None], least: int = LEAST, coverage: float = COVERAGE):
        self.ids, self.least, self.coverage = ids, least, coverage
        self.words, self.first = word_hashes(texts)
        size = np.diff(self.first)
        # Seeds of `least` words, and whole items of fewer: (words of a seed, seeds, their items, mask, filter).
        self.seeds = []
        for width in range(1, least + 1):
            some = size >= least if width == least else size == width
            if some.any():
                self.seeds.append((width, *self._index(width, some)))

    def _index(self, width: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64, np.ndarray]:
        seeds = windows(self.words, width)
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.first))
        inside = (owner[: len(seeds)] == owner[width - 1 :]) & some[owner[: len(seeds)]]
        if width == self.least:
            inside[self._common(seeds, owner, np.flatnonzero(inside))] = False
        seeds, owner = seeds[inside], owner[: len(seeds)][inside]
        order = np.argsort(seeds, kind="stable")
        bits = max(16, int(np.ceil(np.log2(max(1, len(seeds)) * 16))))
        mask = np.uint64((1 << bits) - 1)
        seen = np.zeros(1 << bits, bool)
        seen[seeds & mask] = True
        return seeds[order], owner[order], mask, seen

    def _common(self, seeds: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of the common seeds that are left out of the index."""
        _, name, many = np.unique(seeds[at], return_inverse=True, return_counts=True)
        common = np.flatnonzero(many[name] > COMMON)
        out: list[int] = []
        by_item = common[np.argsort(owner[at[common]], kind="stable")]
        items = owner[at[by_item]]
        cuts = [0, *(np.flatnonzero(items[1:] != items[:-1]) + 1), len(items)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            k = int(items[a])
            start, end = int(self.first[k]), int(self.first[k + 1])
            need, covered = self.coverage * (end - start), np.zeros(end - start, bool)
            for x in by_item[a:b][np.argsort(-many[name[by_item[a:b]]], kind="stable")]:
                place = int(at[x]) - start
                now = covered[place : place + self.least].copy()
                covered[place : place + self.least] = True
                if covered.sum() >= need:
                    covered[place : place + self.least] = now
                    continue
                out.append(int(at[x]))
        return np.array(out, np.int64)

    def _covered(self, k: int, grams: np.ndarray) -> int:
        """Words of item k under the seeds it shares with the sorted ones of a document: as many as tiles can cover at most."""
        own = windows(self.words[self.first[k] : self.first[k + 1]], self.least)
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        shared = (grams[at] == own).astype(np.int64)
        return int((np.convolve(shared, np.ones(self.least, np.int64)) > 0).sum())

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, item, words of the item, words covered, tiles, longest tile) of each text and item at or above the coverage."""
        if not self.seeds:
            return
        words, first = word_hashes(texts)
        found = []
        for width, seeds, owner, mask, seen in self.seeds:
            grams = windows(words, width)
            at = np.flatnonzero(seen[grams & mask])
            row = np.searchsorted(first, at, "right") - 1
            inside = at + width <= first[row + 1]
            # Each seed once for a document.
            pairs = np.unique(np.stack([row[inside], grams[at[inside]].view(np.int64)], 1), axis=0)
            row, gram = pairs[:, 0], pairs[:, 1].copy().view(np.uint64)
            lo, hi = np.searchsorted(seeds, gram, "left"), np.searchsorted(seeds, gram, "right")
            many = hi - lo
            for a, b in _spans(many, HELD_MATCHES):
                m = many[a:b]
                item = owner[np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
                found.append(np.unique(np.repeat(row[a:b], m) * len(self.ids) + item))
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        now, grams = -1, np.zeros(0, np.uint64)
        for r, k in zip((pairs // len(self.ids)).tolist(), (pairs % len(self.ids)).tolist(), strict=True):
            item = self.words[self.first[k] : self.first[k + 1]]
            doc = words[first[r] : first[r + 1]]
            if len(item) >= self.least:
                if r != now:
                    now, grams = r, np.unique(windows(doc, self.least))
                if self._covered(k, grams) < self.coverage * len(item):
                    continue
            tiles = tile(item, doc, min(self.least, len(item)))
            covered = sum(n for _, _, n in tiles)
            if covered >= self.coverage * len(item):
                yield r, k, len(item), covered, len(tiles), max(n for _, _, n in tiles)


def _spans(many: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Spans of about `most` in sum."""
    sums = np.cumsum(many)
    a = 0
    while a < len(many):
        b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, least: int, coverage: float, block_words: int) -> Iterator[Items]:
    """The benchmark in blocks of about block_words words at most, read one partition at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").toLocalIterator():
        words = len(r["t"].split()) + 1
        if ids and size + words > block_words:
            yield Items(ids, texts, least, coverage)
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += words
    if ids:
        yield Items(ids, texts, least, coverage)


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in slices(batches):
            ids = batch.column("id").to_pylist()
            got = list(items.matches(batch.column("text").to_pylist()))
            cols = [[ids[g[0]] for g in got], [items.ids[g[1]] for g in got], *([g[k] for g in got] for k in range(2, 6))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "item_id", "n_words", "n_covered", "n_tiles", "longest"])

    return run


def _keep(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in slices(batches):
            bad = {g[0] for g in items.matches(batch.column(name).to_pylist())}
            keep = pa.array([k not in bad for k in range(batch.num_rows)])
            yield batch.select([k for k in range(batch.num_columns) if batch.schema.names[k] != name]).filter(keep)

    return run


@small_batches
def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item_id, n_words, n_covered, n_tiles, longest, coverage): the documents that hold a benchmark item, and which.

    Words are runs of letters and digits, lower-cased. An item is held if tiles of at least `least` words cover
    the share `coverage` of its words; one of fewer words, even of one, if a document has its whole word sequence. Items
    without words, and null or empty texts, match nothing. A benchmark
    beyond block_words is taken in blocks, each against all documents. Of matches that are as long, the first in the item and
    then in the document becomes a tile. Repeated documents or items give a row each; ids
    may be null; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    schema = "id long, item_id long, n_words long, n_covered long, n_tiles long, longest long"
    out = None
    for items in benchmark_blocks(benchmark, item_col, item_text_col, least, coverage, block_words):
        part = rows.mapInArrow(_find(spark.sparkContext.broadcast(items)), schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumn("coverage", F.col("n_covered") / F.col("n_words"))


@small_batches
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, with all its columns, without the rows that contaminated() finds. Needs no shuffle: each row is decided where it is read."""
    spark = docs.sparkSession
    out = docs
    for items in benchmark_blocks(benchmark, item_col, item_text_col, least, coverage, block_words):
        name = free_name(docs, "text_copy")
        named = out.withColumn(name, F.col(text_col).cast("string"))
        out = named.mapInArrow(_keep(spark.sparkContext.broadcast(items), name), out.schema)
    return out


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    out = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumnRenamed("id", "doc_id")
