"""Token ids in Parquet list columns, for selective reads of tokens and of metadata."""

from __future__ import annotations

import gc
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import Workspace, cut_points, slices, small_batches
from tessera.llm.text import WORDS, blob, splitmix, tokens

#: Words a worker remembers the ids of.
_REMEMBERED = 1_200_000
_known: dict[str, _Encoder] = {}
_SPECIAL = "<|endoftext|>"
#: Bytes that are white space for some libraries, and not a space or a line feed.
_ODD = np.zeros(256, bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
#: Words of more bytes are left to the model one by one.
_SHORT = 64
#: Letters below U+0250. What a byte is in a plain word: a letter, the first or the second byte of one, a digit, a sign. Others (0) are
#: left to the pre-tokenizer, and so are apostrophes, which it may cut off with letters, and what special tokens are written with.
_LETTERS = np.array([k < 0x250 and chr(k).isalpha() for k in range(0x800)])
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 5
_KIND[48:58] = 4
_KIND[:128][_LETTERS[:128]] = 1
_KIND[0xC2:0xCA], _KIND[0x80:0xC0] = 2, 3
_KIND[[ord("'"), ord("|")]] = 0
#: The bytes that the pre-tokenizer keeps together.
_RUN = np.array([0, 1, 1, 1, 4, 5], np.uint8)[_KIND]
#: What stands before a word: nothing, a space, a line feed.
_LEADS = splitmix(3, 23)


class _Words:
    """Ids of words, by a hash of their bytes and of what stands before them."""

    def __init__(self, bits: int = 20):
        self.keys, self.entry = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.order = np.zeros(1024, np.uint64)
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.values, self.n, self.used = np.zeros(4096, np.int32), 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), (keys & mask).astype(np.int64)
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.entry[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], (at[on] + 1) & int(mask)
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """New keys, each once, with their ids one after the other; a size of -1 marks a word that cannot be cut out."""
        total = np.maximum(sizes, 0)
        first = self.used + np.cumsum(total) - total
        new, used = self.n + len(keys), self.used + len(flat)
        self.order, self.start, self.count = (_room(x, new) for x in (self.order, self.start, self.count))
        self.values = _room(self.values, used)
        self.order[self.n : new], self.start[self.n : new], self.count[self.n : new] = keys, first, sizes
        self.values[self.used : used] = flat
        before, self.n, self.used = self.n, new, used
        if 3 * self.n > 2 * len(self.keys):
            bits = int(np.ceil(np.log2(self.n * 2)))
            self.keys, self.entry, before = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0
        self._place(np.arange(before, self.n))

    def _place(self, entries: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (self.order[entries] & np.uint64(mask)).astype(np.int64)
        while len(entries):
            free = np.flatnonzero(self.keys[at] == 0)
            slot, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[slot], self.entry[slot] = self.order[entries[won]], entries[won]
            on = np.ones(len(entries), bool)
            on[won] = False
            # What lost its slot to another looks there again, and goes on.
            entries, at = entries[on], (at[on] + 1) & mask

    def forget(self, n: int) -> None:
        """Keeps the first n entries: the words that came first are the frequent ones."""
        self.n = min(n, self.n)
        self.used = int(self.start[self.n - 1] + max(0, self.count[self.n - 1])) if self.n else 0
        self.keys[:] = 0
        self._place(np.arange(self.n))


def _room(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.zeros(max(n, len(x) * 3 // 2), x.dtype)
    out[: len(x)] = x
    return out


class _Merges:
    """Byte-pair merging of many words at a time, as the model does it: in each, of the pairs with the lowest rank always the first one."""

    #: Stands for no rank.
    NONE = (1 << 31) - 1

    def __init__(self, vocab: dict[str, int], merges: list, symbols: dict[int, str]):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.byte = np.zeros(256, np.int64)
        for b, x in symbols.items():
            self.byte[b] = vocab[x]
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self._key(np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64))
        # As the model reads them: of a pair that is listed twice, the last one counts.
        last = len(keys) - 1 - np.unique(keys[::-1], return_index=True)[1]
        self.shift = np.uint64(62 - max(4, len(keys)).bit_length())
        self.keys, self.ranks = np.zeros(1 << int(64 - self.shift), np.uint64), np.full(1 << int(64 - self.shift), self.NONE, np.int64)
        for rank, key, at in zip(last.tolist(), keys[last], self._slot(keys[last]).tolist(), strict=True):
            while self.keys[at]:
                at = (at + 1) & (len(self.keys) - 1)
            self.keys[at], self.ranks[at] = key, rank

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a << 31) + b + 1).astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or NONE."""
        keys = self._key(a, b)
        at = self._slot(keys)
        out = self.ranks[at]
        there = self.keys[at]
        left = np.flatnonzero((there != keys) & (there != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            out[left] = self.ranks[at]
            on = (there != keys[left]) & (there != 0)
            left, at = left[on], at[on]
        return out

    def merge(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids; the words' bytes, none of them empty, stand one after the other."""
        sym, name, count = self.byte[raw], np.arange(len(size)), np.zeros(len(size), np.int64)
        last = np.cumsum(size) - 1
        rank = np.full(len(sym), self.NONE, np.int64)
        if len(sym) > 1:
            rank[:-1] = self.rank(sym[:-1], sym[1:])
        rank[last] = self.NONE
        names, ids = [], []
        while len(name):
            first = np.cumsum(size) - size
            low = np.minimum.reduceat((rank << 32) + np.arange(len(rank)), first)
            live = (low >> 32) < self.NONE
            if not live.all():
                done = np.repeat(~live, size)
                count[name[~live]] = size[~live]
                names.append(np.repeat(name[~live], size[~live]))
                ids.append(sym[done])
                low = low[live] - (np.cumsum(np.where(live, 0, size)))[live]
                sym, rank, name, size = sym[~done], rank[~done], name[live], size[live]
                first = np.cumsum(size) - size
            at = low & 0xFFFFFFFF
            sym[at] = self.into[low >> 32]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank = sym[keep], rank[keep]
            # One symbol has gone from each word.
            at = at - np.arange(len(at))
            size = size - 1
            first = np.cumsum(size) - size
            rank[at] = self.NONE
            after, before = at[at + 1 < first + size], at[at > first] - 1
            both = np.concatenate([after, before])
            if len(both):
                rank[both] = self.rank(sym[both], sym[both + 1])
        if not names:
            return count, np.zeros(0, np.int64)
        order = np.argsort(np.concatenate(names), kind="stable")
        return count, np.concatenate(ids)[order]


class _Encoder:
    """encode() of a byte-level BPE, word by word.

    A single space, or a single line feed, between two other characters always starts a pre-token of this family of
    tokenizers, so a text whose white space is of these kinds only can be cut there, and each word encoded once: by the
    tokenizer's own model, after its own pre-tokenizer unless the word is plain. Short plain words are merged many at a time,
    if nothing in the tokenizer's file stands against it. Other texts, and those with special tokens, are encoded whole. Words
    are told apart by 64-bit hashes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuttable = self.tokenizer.normalizer is None
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
        # How the pre-tokenizer writes the characters of plain words.
        self.latin = {k: "".join(x for x, _ in self.split(chr(k))) for k in range(0x250)}
        self.space = self.latin[32]
        self.signs = {x: [t.id for t in self.model.tokenize(x)] for x in ".,"}
        self.merges = self._merges(path)
        self.words = _Words()

    def _merges(self, path: str) -> _Merges | None:
        """None if the model is more than merges of bytes, or may cut plain words otherwise."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        more = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        symbols = {b: x for k, written in self.latin.items() for b, x in zip(chr(k).encode(), written, strict=False)}
        if not self.cuttable or model.get("type") != "BPE" or any(model.get(x) for x in more) or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        if any(x not in model["vocab"] for x in symbols.values()):
            return None
        return _Merges(model["vocab"], model["merges"], symbols)

    def encode(self, buf: np.ndarray, off: np.ndarray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with `end` behind, and how many each row has."""
        rows = len(off) - 1
        h, where, first = tokens(buf, off, fold=False)
        row = np.repeat(np.arange(rows), np.diff(first))
        odd = self._odd(buf, off)
        used = np.flatnonzero(~odd[row])
        lead = np.where(where[used] == off[row[used]], 0, np.where(buf[where[used] - 1] == 10, 2, 1))
        keys = h[used] ^ _LEADS[lead]
        keys[keys == 0] = 1
        at = self.words.find(keys)
        if (new := np.flatnonzero(at < 0)).size:
            names, pick = np.unique(keys[new], return_index=True)
            pick = new[pick]
            if self.words.n + len(names) > _REMEMBERED:
                self.words.forget(_REMEMBERED * 3 // 4)
                at = self.words.find(keys)
                new = np.flatnonzero(at < 0)
                names, pick = np.unique(keys[new], return_index=True)
                pick = new[pick]
            # In the order in which they came.
            order = np.argsort(pick, kind="stable")
            names, pick = names[order], pick[order]
            last = np.append(where, off[-1])
            word = used[pick]
            ends = np.where(first[row[word] + 1] == word + 1, off[row[word] + 1], last[word + 1] - 1)
            self.words.add(names, *self._learn(buf, where[word], ends, lead[pick]))
            at[new] = self.words.find(keys[new])
        count = self.words.count[at]
        odd[row[used[count < 0]]] = True
        good = ~odd[row[used]]
        at, owner, count = at[good], row[used][good], count[good].astype(np.int64)
        inner = np.cumsum(count) - count
        flat = self.words.values[np.repeat(self.words.start[at] - inner, count) + np.arange(int(count.sum()))]
        sizes = np.bincount(owner, count, rows).astype(np.int64) if len(owner) else np.zeros(rows, np.int64)
        whole = {r: self.tokenizer.encode(buf[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids for r in np.flatnonzero(odd).tolist()}
        plain = sizes.copy()
        for r, ids in whole.items():
            sizes[r], plain[r] = len(ids), 0
        sizes += len(end)
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        out[np.repeat(begin - (np.cumsum(plain) - plain), plain) + np.arange(len(flat))] = flat
        for r, ids in whole.items():
            out[begin[r] : begin[r] + len(ids)] = ids
        for k, x in enumerate(end):
            out[begin + sizes - len(end) + k] = x
        return out, sizes

    def _odd(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows with white space other than single spaces and line feeds between words."""
        rows = len(off) - 1
        odd = np.full(rows, not self.cuttable)
        lo, hi = int(off[0]), int(off[-1])
        raw = buf[lo:hi]
        if not len(raw):
            return odd
        blank = WORDS[raw] == 0
        held = np.flatnonzero(np.diff(off))
        odd[held] |= blank[off[held] - lo] | blank[off[held + 1] - 1 - lo]
        double = np.flatnonzero(blank[1:] & blank[:-1]) + 1 + lo
        # Blanks at the ends of two rows are found above.
        for places in (double, np.flatnonzero(_ODD[raw]) + lo):
            odd[np.searchsorted(off, places, "right") - 1] = True
        return odd

    def _learn(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids."""
        easy = _plain(buf, begin, end - begin) if self.merges else np.zeros(len(begin), bool)
        hard, easy = np.flatnonzero(~easy), np.flatnonzero(easy)
        sizes = np.zeros(len(begin), np.int64)
        sizes[hard], others = self._learn_words([buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(begin[hard].tolist(), end[hard].tolist(), strict=True)], lead[hard].tolist())
        if not len(easy):
            return sizes.astype(np.int32), others
        before = lead[easy]
        first = begin[easy] - (before > 0)
        size = end[easy] - first
        raw = buf[_spans(first, size)]
        # A space goes with what follows, a line feed is a piece of its own, and so is each run of letters, of digits and of signs.
        kind, first = _RUN[raw], np.cumsum(size) - size
        kind[first[before == 1]] = kind[first[before == 1] + 1]
        cut = np.ones(len(raw), bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut[first] = True
        pieces = np.flatnonzero(cut)
        count, ids = self.merges.merge(raw, np.diff(pieces, append=len(raw)))
        count = np.add.reduceat(count, np.searchsorted(pieces, first))
        sizes[easy] = count
        held = np.maximum(sizes, 0)
        first = np.cumsum(held) - held
        flat = np.zeros(int(held.sum()), np.int32)
        flat[_spans(first[hard], held[hard])] = others
        flat[_spans(first[easy], count)] = ids
        return sizes.astype(np.int32), flat

    def _learn_words(self, words: list[str], leads: list[int]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, latin, space, signs = self.model.tokenize, self.latin, self.space, self.signs
        sizes, flat = [], []
        collecting = gc.isenabled()
        gc.disable()  # many small objects, none in a cycle
        try:
            for word, lead in zip(words, leads, strict=True):
                if lead == 1:
                    sign = signs.get(word[-1])
                    stem = word[:-1] if sign else word
                    if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250"):
                        # The pre-tokenizer writes ASCII letters as they are.
                        ids = [x.id for x in tokenize(space + (stem if stem.isascii() else stem.translate(latin)))]
                        if sign:
                            ids += sign
                        sizes.append(len(ids))
                        flat += ids
                        continue
                if word.split() != [word] or _SPECIAL in word:
                    sizes.append(-1)
                    continue
                ids = [x.id for w, _ in self.split(("", " ", "\n")[lead] + word) for x in tokenize(w)]
                sizes.append(len(ids))
                flat += ids
        finally:
            if collecting:
                gc.enable()
        return np.array(sizes, np.int32), np.array(flat, np.int32)


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs that begin at first, one run after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _plain(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether words are of 1 to _SHORT bytes, and of letters below U+0250, ASCII digits and signs only."""
    out = (size > 0) & (size <= _SHORT)
    some = np.flatnonzero(out)
    if not len(some):
        return out
    size = size[some]
    raw = buf[_spans(begin[some], size)]
    first = np.cumsum(size) - size
    kind = _KIND[raw]
    good = kind > 0
    # A letter of two bytes: both stand in one word, and each beside the other.
    lead, rest = kind == 2, kind == 3
    opens, closes = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    opens[first] = closes[first + size - 1] = True
    good &= ~(lead & closes) & ~(rest & opens)
    good[1:] &= ~rest[1:] | lead[:-1]
    good[:-1] &= ~lead[:-1] | rest[1:]
    at = np.flatnonzero(lead[:-1] & rest[1:])
    good[at] &= _LETTERS[((raw[at].astype(np.int64) & 31) << 6) | (raw[at + 1] & 63)]
    out[some] = np.logical_and.reduceat(good, first)
    return out


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _known:
            _known.clear()
            _known[path] = _Encoder(path)
        at, part = 0, None
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            flat, sizes = _known[path].encode(*blob(batch.column("text")), [end])
            parts = batch.column("part").to_numpy()
            if part != parts[0]:
                at = 0
            # A task holds whole parts, one after the other.
            ends = np.cumsum(sizes)
            starts = ends - sizes + at
            for k in np.flatnonzero(parts[1:] != parts[:-1]) + 1:
                starts[k:] -= starts[k]
            at, part = int(starts[-1] + sizes[-1]), parts[-1]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("id"), pa.array(starts), pa.array(sizes), ids], ["part", "doc_id", "start_in_part", "n_tokens", "ids"])

    return run


@small_batches
def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0, parts: int | None = None, row_group_mb: int = 16, page_kb: int = 64, encoding: str = "dictionary") -> DataFrame:
    """Writes (part, doc_id, start_in_part, n_tokens, ids) under path, in ascending doc_id, and returns the table as read back.

    tokenizer: file of a byte-level BPE for the tokenizers library. Each document's ids are followed by `end`. Part k
    holds smaller ids than part k + 1 and is the k-th file; rows with a null id come first. encoding "dictionary" gives
    bit-packed dictionary pages, "delta" the v2 writer's delta pages. Row groups and pages are bounded, and page indexes
    are written, so that reads of some documents or of metadata alone touch few pages. Null text is empty. Repeated ids
    are kept, each as its own row. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    cuts = cut_points(rows, "id", parts)
    # A binary search for each row. Equal ids get the same part, and the order of ids is that of parts.
    splits = [float("-inf"), *sorted({float(x) for x in cuts}), float("inf")]
    if not cuts:
        splits.insert(1, 0.0)
    place = Bucketizer(splits=splits, inputCol="place", outputCol="bucket", handleInvalid="keep").transform(rows.withColumn("place", F.col("id").cast("double")))
    dealt = place.withColumn("part", F.when(F.col("id").isNull(), 0).otherwise(F.col("bucket").cast("int"))).select("id", "text", "part").repartitionById(len(splits) - 1, F.col("part")).sortWithinPartitions("part", "id")
    coded = dealt.mapInArrow(_encode(tokenizer, end), "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>")
    writer = coded.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).option("parquet.block.size", row_group_mb << 20).option("parquet.page.size", page_kb << 10)
    if encoding == "delta":
        writer = writer.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "v2")
    elif encoding != "dictionary":
        raise ValueError(f"unknown encoding: {encoding}")
    writer.parquet(path)
    return read_tokens(spark, path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written table; select columns or filter by doc_id to read only their pages."""
    return spark.read.schema("part int, doc_id long, start_in_part long, n_tokens long, ids array<int>").parquet(path)


def part_starts(table: DataFrame) -> DataFrame:
    """(part, before): ids in all earlier parts; reads metadata only. There is a row for each file."""
    sums = table.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    total, found = 0, []
    for x in sums:
        found.append((x["part"], total))
        total += x["n"]
    return table.sparkSession.createDataFrame(found, "part int, before long")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids = batch.column("ids")
        off, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).view("<u4")
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(sums, pa.int64())], ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])


def token_digest(table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a written table."""
    read = table.mapInArrow(_crc, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(part_starts(table)), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


@small_batches
def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """token_digest of docs, encoded with the public 50k byte-level BPE and end id 0. The files are written to path, or else to
    the shared scratch folder."""
    import public_tokenizers

    path = path or Workspace(docs.sparkSession, "tokens").path("ids")
    return token_digest(write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json")))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the token files of documents."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
