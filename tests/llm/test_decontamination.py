import random
import time

import numpy as np

from tessera.llm import decontamination
from tessera.llm.decontamination import Items, contaminated, drop_contaminated, tile, word_hashes


def greedy(item, doc, least):
    """The definition: again and again the longest match of uncovered values, by trying all."""
    tiles, mi, md = [], [False] * len(item), [False] * len(doc)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mi[i + n] and not md[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        for k in range(n):
            mi[i + k] = md[j + k] = True
        tiles.append((i, j, n))


def test_tiles_are_those_of_greedy_tiling(monkeypatch):
    rng = random.Random(2)
    for k in range(400):
        monkeypatch.setattr(decontamination, "HELD_MATCHES", rng.choice([1, 7, 1 << 20]))
        values = rng.choice([1, 2, 9, 9, 30])
        item = [rng.randrange(values) for _ in range(rng.randrange(1, 24))]
        doc = [rng.randrange(values) for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(len(item))
            doc[rng.randrange(len(doc) + 1) :] = item[a : a + rng.randrange(1, 15)]
        assert tile(np.array(item, np.uint64), np.array(doc, np.uint64), 3) == greedy(item, doc, 3)


def test_decisions_against_brute_force(spark, monkeypatch):
    """Items that share seeds, repetitive ones and such as hold ties; what is held, with its coverage, by the definition."""
    monkeypatch.setattr(decontamination, "COMMON", 2)
    rng = random.Random(6)
    opening = "which of the following is true"
    names = [f"n{i}" for i in range(40)]
    items = [f"{opening} {' '.join(rng.choice(names) for _ in range(rng.randrange(0, 25)))}" for _ in range(12)]
    items += ["a a a a a a a a a a a a", "a b a b a b a b a b a b a b", opening, "one two", "", None, items[0]]
    docs = []
    for k in range(50):
        words = [rng.choice(names) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            part = (rng.choice(items) or "x").split()
            a = rng.randrange(max(1, len(part) // 2))
            words[rng.randrange(len(words) + 1) : 0] = part[a : a + rng.randrange(1, 30)]
        docs.append((k, " ".join(words)))
    docs += [(90, "a " * 60), (91, "a b " * 40), (92, f"{opening} " * 5), (93, "one two"), (94, ""), (95, None), (96, items[3])]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    want = []
    for i, text in docs:
        for k, item in enumerate(items):
            a, b = (item or "").split(), (text or "").split()
            tiles = greedy(a, b, min(5, len(a))) if a and b else []
            covered = sum(n for *_, n in tiles)
            if tiles and covered >= 0.5 * len(a):
                want.append((i, k, len(a), covered, len(tiles), max(n for *_, n in tiles)))
    assert sorted((r.id, r.item_id, r.n_words, r.n_covered, r.n_tiles, r.longest) for r in got) == sorted(want) and len(want) > 30


def test_shared_seeds_and_repetitive_texts_are_cheap():
    began = time.time()
    items = Items(list(range(20_000)), [f"which of the following is {' '.join(f'w{k}x{j}' for j in range(12))}" for k in range(20_000)])
    built = time.time()
    assert list(items.matches(["so which of the following is not here " * 20])) == []
    assert [m[:2] for m in items.matches(["which of the following is " + " ".join(f"w7x{j}" for j in range(12))])] == [(0, 7)]
    assert time.time() - built < 1 and built - began < 10
    began = time.time()
    assert len(tile(np.zeros(60, np.uint64), np.zeros(100_000, np.uint64))) == 1
    assert sum(n for *_, n in tile(np.arange(60, dtype=np.uint64) % 2, np.arange(50_000, dtype=np.uint64) % 2)) == 60
    assert time.time() - began < 3


def test_word_hashes():
    h, first = word_hashes(["Élan—vital, 12!", None, "élan “VITAL” 12"])
    assert first.tolist() == [0, 3, 3, 6] and h[:3].tolist() == h[3:].tolist()


WORDS = [f"word{i}" for i in range(60)]
ITEM = " ".join(WORDS[:30])


def test_documents(spark):
    docs = [
        (1, "x y z " + ITEM + " and more"),
        (2, " ".join(WORDS[15:30]) + "\nbetween\n" + " ".join(WORDS[:15]).upper()),
        (3, " ".join(WORDS[:12])),
        (4, " ".join(WORDS[30:60])),
        (5, None),
        (6, ""),
        (7, "filler " * 40_000 + ITEM),
        (8, ", ".join(w if k % 7 else "changed" for k, w in enumerate(WORDS[:30]))),
        (9, " ".join(WORDS[i] for i in range(0, 30, 2))),
        (None, ITEM),
        (1, ITEM),
    ]
    items = [(10, ITEM), (11, "too short"), (12, None), (13, ""), (14, "word40 word41 word42 word43 word44")]
    d = spark.createDataFrame([(i, t, "a", "b") for i, t in docs], "doc_id long, text string, id string, _score string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, id int")
    for block in (4_000_000, 3):
        got = sorted((r.id or 0, r.item_id) for r in contaminated(d, b, block_words=block).collect())
        assert got == [(0, 10), (1, 10), (1, 10), (2, 10), (4, 14), (7, 10), (8, 10)]
        kept = drop_contaminated(d, b, block_words=block)
        assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 9]
    r = contaminated(d.where("doc_id = 2"), b).first()
    assert (r.n_words, r.n_covered, r.n_tiles, r.longest, r.coverage) == (30, 30, 2, 15, 1.0)
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0
    assert drop_contaminated(d, b.limit(0)).count() == len(docs)


def test_items_shorter_than_a_seed_are_held_by_their_whole_sequence(spark):
    docs = [(1, "x y Alpha, beta; GAMMA delta z"), (2, "alpha beta gamma"), (3, "alpha beta x gamma delta"), (4, "so lonely here"), (5, "alpha"), (6, "beta gamma delta"), (7, "alpha beta gamma"), (8, "delta of it"), (9, ITEM + " alpha beta gamma delta")]
    items = [(20, "alpha beta gamma delta"), (21, "lonely"), (22, "delta of"), (23, " ,. "), (24, None), (25, ITEM), (26, "word1 word2 word3")]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 3):
        got = sorted((r.id, r.item_id, r.n_words, r.n_covered, r.n_tiles, r.longest) for r in contaminated(d, b, block_words=block).collect())
        assert got == [(1, 20, 4, 4, 1, 4), (4, 21, 1, 1, 1, 1), (8, 22, 2, 2, 1, 2), (9, 20, 4, 4, 1, 4), (9, 25, 30, 30, 1, 30), (9, 26, 3, 3, 1, 3)]
        assert sorted(r.doc_id for r in drop_contaminated(d, b, block_words=block).collect()) == [2, 3, 5, 6, 7]
