"""Vectorised tokens and shingles: hashes of words, straight from the bytes of Arrow columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Python patterns for the contracts' white space and words.
BLANK = " \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Class of each byte where words are runs without white space; 0 separates.
WORDS = np.ones(256, np.uint8)
WORDS[[9, 10, 11, 12, 13, 32]] = 0
#: Longer tokens are hashed one by one.
_FAST = 4096


def splitmix(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    z = np.full(n, seed, np.uint64) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_EXACT = splitmix(256, 1)
_BYTES = _EXACT[LOWER]
_POWERS = np.multiply.accumulate(np.full(_FAST, 0x2545F4914F6CDD1D, np.uint64))
_PLACES = splitmix(64, 2) | np.uint64(1)


def blob(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def _pieces(buf: np.ndarray, off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts of about limit bytes, between rows or else at white space."""
    at, end = int(off[0]), int(off[-1])
    while at < end:
        cut = min(at + limit, end)
        if cut < end:
            k = int(np.searchsorted(off, cut, "right")) - 1
            if off[k] > at:
                cut = int(off[k])
            else:
                last = int(off[k + 1])
                while cut < last and WORDS[buf[cut]]:
                    cut += 1
        yield at, cut
        at = cut


def tokens(buf: np.ndarray, off: np.ndarray, classes: np.ndarray = WORDS, limit: int = 1 << 18, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one class, A-Z lower-cased if fold: their hashes, where each starts, and the first token of each row (and of the end).

    classes must give 0 to white space.
    """
    table = np.where(classes > 0, _BYTES if fold else _EXACT, np.uint64(0))
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in _pieces(buf, off, limit):
        raw = buf[lo:hi]
        cls = classes[raw]
        first = np.empty(hi - lo, bool)
        first[0] = True
        np.not_equal(cls[1:], cls[:-1], out=first[1:])
        a, b = np.searchsorted(off, [lo, hi])
        first[off[a:b] - lo] = True
        first &= cls != 0
        st = np.flatnonzero(first)
        if not len(st):
            continue
        body, rel = raw[st[0] :], st - st[0]
        gap = np.diff(rel, append=len(body))
        pos = np.arange(len(body)) - np.repeat(rel, gap)
        np.minimum(pos, _FAST - 1, out=pos)
        term = table[body]
        term *= _POWERS[pos]
        h = np.add.reduceat(term, rel)
        for i in np.flatnonzero(gap > _FAST):
            span = body[rel[i] : rel[i] + gap[i]]
            span = span[classes[span] > 0]
            if len(span) > _FAST:
                h[i] = int.from_bytes(hashlib.blake2b((LOWER[span] if fold else span).tobytes(), digest_size=8).digest(), "little")
        hashes.append(h)
        starts.append(st + lo)
    where = np.concatenate(starts)
    return mix(np.concatenate(hashes)), where, np.searchsorted(where, off)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive tokens."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(m, n, np.uint64)
    for i in range(n):
        total += h[i : i + m] * _PLACES[i]
    return mix(total)


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row its distinct n-word shingles, sorted, as signed hashes; with fewer words, the whole sequence as one."""
    h, _, first = tokens(buf, off)
    grams = windows(h, n).view(np.int64)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        else:
            yield windows(h[a:b], int(b - a)).view(np.int64) if b > a else np.zeros(0, np.int64)
