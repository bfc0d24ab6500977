"""Language ID by rank-order profiles: the most frequent n-grams of a document against those of each language."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import slices, small_batches

#: Length of a profile, and the longest n-gram (at most 3: an n-gram is packed in 63 bits).
PROFILE, LONGEST = 300, 3
#: Characters read at a time.
_CHUNK = 1 << 20
#: Counts of n-grams that a task holds.
HELD_NGRAMS = 1 << 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased words with one space before, between and behind; empty if there is no letter."""
    if not text:
        return np.zeros(0, np.int64)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    word = _is_letter()[cp]
    if not word.any():
        return np.zeros(0, np.int64)
    cp[~word] = 32
    keep = word.copy()
    keep[1:] |= word[:-1]
    cp = cp[keep]
    return np.concatenate([[32] if cp[0] != 32 else [], cp, [32] if cp[-1] != 32 else []]).astype(np.int64)


def count_ngrams(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending, and counts of the 1- to LONGEST-grams of a sequence; one of a space alone is none."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, local = np.unique(cp, return_inverse=True)
    base = len(names) + 1
    local = local + 1
    if base**LONGEST <= max(1 << 15, 64 * len(cp)) and base**LONGEST <= 1 << 24:
        total = np.zeros(base**LONGEST, np.int64)
        for n in range(1, LONGEST + 1):
            total += np.bincount(_packed(local, n, base), minlength=base**LONGEST)
        at = np.flatnonzero(total)
        count = total[at]
    else:
        at, count = np.unique(np.concatenate([_packed(local, n, base) for n in range(1, LONGEST + 1)]), return_counts=True)
    wide = np.concatenate([[0], names])
    code = np.zeros(len(at), np.int64)
    for k in range(LONGEST):
        code = code << 21 | wide[at // base ** (LONGEST - 1 - k) % base]
    alone = code == 32 << 21 * (LONGEST - 1)
    return code[~alone], count[~alone]


def _packed(x: np.ndarray, n: int, base: int) -> np.ndarray:
    m = len(x) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    code = np.zeros(m, np.int64)
    for k in range(LONGEST):
        code = code * base + (x[k : k + m] if k < n else 0)
    return code


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in held]), len(code)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of each language over a task's documents, given out whenever HELD_NGRAMS of them are held."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (code, count) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(count)], ["lang", "code", "n"])
        held.clear()

    for batch in slices(batches):
        texts: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            # Words do not run on from one text to the next, so texts are counted together. A space before a word is
            # the one behind the word before, so n-grams from word to word occur; they are part of a profile.
            for x in _joined(letters(t) for t in some):
                more = count_ngrams(x)
                held[lang] = _merge([held[lang], more]) if lang in held else more
                if sum(len(code) for code, _ in held.values()) >= HELD_NGRAMS:
                    yield from out()
    yield from out()


def _joined(parts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Texts behind each other, about _CHUNK characters at a time, one space between two."""
    size, now = 0, []
    for x in parts:
        if len(x):
            now.append(x[:-1])
            size += len(x)
            if size > _CHUNK:
                yield np.concatenate([*now, [32]])
                now, size = [], 0
    if now:
        yield np.concatenate([*now, [32]])


def learn_profiles(texts: DataFrame, length: int = PROFILE) -> dict[str, np.ndarray]:
    """Codes of each language's most frequent n-grams, the most frequent first, over all rows of texts (lang, text)."""
    counts = texts.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    turn = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counts.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= length).collect()
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["code"])
    return {lang: np.array(codes, np.int64) for lang, codes in found.items()}


class Ranks:
    """Profiles, laid out for the distance of a document to all of them at once."""

    def __init__(self, profiles: dict[str, np.ndarray], length: int = PROFILE):
        self.names, self.length = sorted(profiles), length
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        # The last column is for n-grams that no profile has; a missing one is `length` places off.
        self.rank = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.names):
            self.rank[i, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language at the least out-of-place distance, and how far the next one is behind, 0 to 1."""
        code, count = count_ngrams(letters(text or ""))
        if not len(code) or not self.names:
            return "und", 0.0
        top = code[np.argsort(-count, kind="stable")[: self.length]]
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        at = np.where(self.codes[at] == top, at, len(self.codes))
        rank = self.rank[:, at]
        off = np.where(rank < 0, self.length, np.abs(rank - np.arange(len(top)))).sum(1)
        best = int(np.argmin(off))
        rest = np.delete(off, best)
        worst = self.length * len(top)
        behind = (rest.min() if len(rest) else worst) - off[best]
        return self.names[best], float(behind / max(1, rest.min() if len(rest) else worst))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in slices(batches):
            found = [ranks.predict(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "lang_pred", "score"])

    return run


@small_batches
def identify_languages(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", length: int = PROFILE) -> DataFrame:
    """(id, lang_pred, score), one row for each row of docs.

    Profiles are learned from the text and language of the rows where `learn` holds and the language is not null, all of
    them. lang_pred is a learned language, the first in order at a tie; `und`, with score 0, if the text is null, has
    no letter, or nothing was learned. score: the share by which the next language is farther. Rows may repeat; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), learn.alias("learn"))
    profiles = learn_profiles(rows.where("learn AND lang IS NOT NULL AND text IS NOT NULL").select("lang", "text"), length)
    shared = spark.sparkContext.broadcast(Ranks(profiles, length))
    return rows.select("id", "text").mapInArrow(_predict(shared), "id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    from tessera.llm.quality import remainder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify_languages(docs, remainder("doc_id", 4) != 2)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(remainder("id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
