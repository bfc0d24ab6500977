import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, ngram_join
from tessera.llm.embedding_dedup import near_duplicates
from tessera.llm.ngram_join import components, ngram_components, overlaps
from tessera.llm.shared import Workspace, connected_components


def smallest(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in nodes}


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 2000 + i) for i in range(50)]
    got = connected_components(Workspace(spark, "test"), spark.createDataFrame(edges, "u long, v long"), "t").collect()
    want = smallest({x for e in edges for x in e}, edges)
    assert {r.node: r.component for r in got} == {x: c for x, c in want.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_overlaps_and_components():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(12)]
    want = np.array([[len(set(a) & set(b)) for b in sets] for a in sets])
    assert (overlaps(sets, width=7) - np.diag(np.diag(overlaps(sets, width=7))) == want - np.diag(np.diag(want))).all()
    assert (overlaps(sets[:5], sets[5:], width=7) == want[:5, 5:]).all()
    m = np.zeros((5, 5), bool)
    m[0, 3] = m[3, 0] = m[3, 4] = m[4, 3] = True
    assert components(m).tolist() == [0, 1, 2, 0, 0]


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c < "\x80" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = smallest(list(sets), links)
    return sorted((i, len(sets[i]), comp[i]) for i in sets)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 9, 30, 60, 120]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += ["", None, "A b", "a B", "a b c", " a\tb c ", "x " * 300, "x " * 300 + "y", rows[0], rows[0]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,n,num,den", [(1, 4, 85, 100), (2, 5, 80, 100), (3, 1, 50, 100), (4, 2, 100, 100)])
def test_ngram_join(spark, seed, n, num, den):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "u", "v") for i, t in rows], "doc_id long, text string, id string, n string")
    got = sorted(map(tuple, ngram_components(df, n=n, num=num, den=den).collect()))
    assert got == brute(rows, n, num, den)


@pytest.mark.parametrize("held,filter_words", [(1 << 18, 1 << 18), (7, 1)])
def test_ngram_join_large_clusters(spark, monkeypatch, held, filter_words):
    for name, value in (("BLOCK_SETS", 4), ("PAIR_LIST", 3), ("DELEGATES", 2), ("HELD_POSTINGS", held), ("FILTER_WORDS", filter_words)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(45):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 3, 4])):
            copy[rng.randrange(len(copy))] = f"m{rng.randrange(9)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, t) for i, t in corpus(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_components(df).collect())) == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("held,spread", [(1 << 18, 1 << 14), (7, 1 << 14), (7, 5)])
def test_ngram_join_common_shingles(spark, monkeypatch, held, spread):
    """Lists beyond PAIR_LIST, whole, cut by what is held, and spread: the components are those of brute force."""
    for name, value in (("PAIR_LIST", 3), ("HELD_POSTINGS", held), ("SPREAD", spread)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    tails = [[rng.choice(words) + f"-{k}" for _ in range(40)] for k in range(30)]
    rows = [(2 * k + j, " ".join(["of", "the", "and", "in", *(reversed(t) if j else t)])) for k, t in enumerate(tails) for j in (0, 1)]
    rows += [(200 + k, rows[k][1] + " more") for k in (4, 9, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_components(df, n=1, num=50, den=100, share=1.0).collect())) == brute(rows, 1, 50, 100)
    assert sorted(map(tuple, ngram_components(df).collect())) == brute(rows, 4, 85, 100)


@pytest.mark.parametrize("num", [85, 80])  # of the operator and of the pipeline
def test_ngram_candidates_of_a_common_shingle(spark, num):
    """200 unlike sets of one size share a shingle: none of them hang together, wherever the shingle's list ends."""
    rng = np.random.default_rng(6)
    count = lambda s: np.bincount(s & (ngram_join.BINS - 1), minlength=ngram_join.BINS).tolist()
    rows = [(i, 75, count(rng.integers(0, 2**62, 75)), 5, 0) for i in range(200)]
    postings = spark.createDataFrame(rows + [(900, *rows[7][1:])], "id long, n int, hist array<int>, g long, pos int").repartition(5)
    found = ngram_join._candidates(Workspace(spark, "test"), postings, num, 100).where("u <> v").collect()
    assert [sorted((r.u, r.v)) for r in found] == [[7, 900]]


@pytest.mark.parametrize("delegates", [1, 16])
def test_ngram_candidates_of_a_list_cut_into_runs(spark, monkeypatch, delegates):
    """A list beyond SPREAD, of unlike sets of like sizes with a few near copies: no unlike sets hang together, and copies do across runs."""
    monkeypatch.setattr(ngram_join, "SPREAD", 32)
    monkeypatch.setattr(ngram_join, "DELEGATES", delegates)
    rng = np.random.default_rng(7)
    count = lambda s: np.bincount(s & (ngram_join.BINS - 1), minlength=ngram_join.BINS).tolist()
    sets = [rng.integers(0, 2**62, int(rng.integers(70, 90))) for _ in range(150)]
    rows = [(i, len(s), count(s), 5, 0) for i, s in enumerate(sets)]
    rows += [(1000 + i, len(sets[i]) - 3, count(sets[i][3:]), 5, 0) for i in range(20)]
    # Near copies of one size, more of them than a run holds.
    rows += [(2000 + k, 75, count(np.append(sets[149][:67], rng.integers(0, 2**62, 8))[:75]), 5, 0) for k in range(60)]
    postings = spark.createDataFrame(rows, "id long, n int, hist array<int>, g long, pos int").repartition(5)
    found = ngram_join._candidates(Workspace(spark, "test"), postings, 80, 100).where("u <> v").collect()
    n, hist = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    links = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if 180 * np.minimum(hist[i], hist[j]).sum() >= 80 * (n[i] + n[j])]
    nodes = [r[0] for r in rows]
    assert smallest(nodes, [(r.u, r.v) for r in found]) == smallest(nodes, links)
    assert len(set(smallest(nodes, links).values())) > 100


def test_apart():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 2**62, rng.integers(40, 60))) for _ in range(30)]
    asked = [np.append(s[3:], rng.integers(0, 2**62, 2)) for s in sets[:12]]
    sets.sort(key=len)
    every = asked + sets
    n = np.array([len(s) for s in every])
    hist = np.stack([np.bincount(s & (ngram_join.BINS - 1), minlength=ngram_join.BINS) for s in every])
    label = np.array([100 + i // 2 if i < 12 else 200 + i for i in range(len(every))])
    links = [(label[i], label[j]) for i in range(12) for j in range(12, len(every)) if 180 * np.minimum(hist[i], hist[j]).sum() >= 80 * (n[i] + n[j])]
    u, v = ngram_join.apart(n, n, hist, label, 12, 80, 100)
    assert len(links) >= 12 and smallest(label.tolist(), zip(u.tolist(), v.tolist(), strict=True)) == smallest(label.tolist(), links)


def test_reached():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(-(2**62), 2**62, 50)) for _ in range(40)]
    sets += [np.unique(np.append(s[2:], rng.integers(-(2**62), 2**62, 2))) for s in sets[:25] for _ in range(3)]
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    hist = np.stack([np.bincount(s & (ngram_join.BINS - 1), minlength=ngram_join.BINS) for s in sets])
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (n[i] + n[j])]
    want = smallest(range(len(sets)), links)
    # Every link is kept, and unlike sets of like sizes are told apart.
    assert ngram_join.reached(n, n, hist, 85, 100).tolist() == [want[i] for i in range(len(sets))]


def test_ngram_join_empty_and_null_ids(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e"), (2, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (8, None)]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.id or 0), r.n_shingles, r.component_id or 0) for r in got) == [(0, 2, 0), (2, 2, 2), (7, 2, 2), (7, 2, 2), (8, 0, 8)]


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(6):
        centre = rng.standard_normal(16)
        for _ in range(12):
            rows.append((centre + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.35, 1]), k % 3))
    rows += [rows[0]] * 9 + [(rows[1][0] * 40, rows[1][1])]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [], 1), (903, [1.0, None] * 8, 1), (904, [float("nan")] * 16, 1), (905, [float("inf")] + [1.0] * 15, 1), (906, rows[0][1], None), (907, rows[0][1][:8], rows[0][2])]
    return rows


def brute_vectors(rows):
    """(id, links, component, kept) of each row, by comparing all rows; rows are nodes of their own."""
    good = {k: (np.array(v, float), label) for k, (i, v, label) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and label is not None}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.sqrt((good[a][0] @ good[a][0]) * (good[b][0] @ good[b][0])) >= 0.93]
    comp = smallest(list(range(len(rows))), links)
    least = {}
    for k, c in comp.items():
        if rows[k][0] is not None:
            least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return sorted(((i, sum(k in e for e in links), least[comp[k]], least[comp[k]] == i) for k, (i, _, _) in enumerate(rows) if i is not None))


@pytest.mark.parametrize("block,pivots", [(2048, 128), (7, 5), (4, 40)])
def test_near_duplicates(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "PIVOTS", pivots)
    monkeypatch.setattr(embedding_dedup, "HELD_NUMBERS", 100)
    rows = vectors(4)
    # Ids that stand for several vectors.
    rows += [(1, rows[40][1], rows[40][2]), (1, [-x for x in rows[3][1]], rows[3][2]), (2, rows[60][1], rows[60][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, id string, many int")
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute_vectors(rows)


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (None, [1.0, 0.0], 0)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0), (1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_blocks_that_are_far_apart_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 10)
    monkeypatch.setattr(embedding_dedup, "PIVOTS", 12)
    rng = np.random.default_rng(2)
    centres = np.eye(8)
    rows = [(i, [float(x) for x in centres[i % 8] + rng.standard_normal(8) * 0.05], 1) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ws = Workspace(spark, "test")
    distinct = ws.stash(df.select(F.col("vec_id").alias("id"), F.col("label").cast("long"), F.col("embedding").alias("v")).mapInArrow(embedding_dedup._prepare, "id long, label long, dim int, vec binary, k1 long, k2 long"), "rows")
    distinct = distinct.select("label", "dim", F.col("k1").alias("id"), "k2", F.col("id").alias("stand"), F.lit(1).cast("long").alias("many"), "vec")
    dealt = embedding_dedup._deal(ws, distinct, 0.93)
    assert dealt.count() < 160 * 16 / 3
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute_vectors(rows)


def test_near_duplicates_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_ngram_join_long_texts(spark):
    rng = random.Random(9)
    long_ = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    near = list(long_)
    near[5] = near[70_000] = "changed"
    rows = [(1, " ".join(near)), (2, " ".join(long_)), (3, "y" * 300_000), (4, "y" * 300_000), (5, "y" * 299_999 + "z"), (6, " ".join(long_[:60_000]))]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


def test_texts_of_one_id_have_components_of_their_own(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, a), (5, b), (2, b), (9, a), (5, a), (None, b)]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.component_id or 0) for r in got) == [(0, 0), (2, 2), (5, 2), (5, 5), (5, 5), (9, 5)]


def test_candidates_hold_all_links_however_lists_are_cut(spark, monkeypatch):
    """Postings of a few shingles, in lists that go from batch to batch and from task to task: sets that share one and are alike hang together."""
    monkeypatch.setattr(ngram_join, "PAIR_LIST", 3)
    monkeypatch.setattr(ngram_join, "HELD_POSTINGS", 6)
    rng = random.Random(8)
    sizes = {i: rng.choice([10, 11, 12, 20, 21, 40]) for i in range(80)}
    lists = {(g, i) for g, most in ((1, 60), (2, 3), (3, 2), (4, 25), (5, 2)) for i in rng.sample(range(80), most)}
    rows = [(i, sizes[i], [sizes[i] // 8 + (k < sizes[i] % 8) for k in range(8)], g, 0) for g, i in lists]
    postings = spark.createDataFrame(rows, "id long, n int, hist array<int>, g long, pos int").repartition(5)
    found = ngram_join._candidates(Workspace(spark, "test"), postings, 85, 100).collect()
    got = smallest(range(80), [(r.u, r.v) for r in found])
    alike = lambda i, j: min(sizes[i], sizes[j]) * 100 >= 85 * max(sizes[i], sizes[j])
    for g, i in lists:
        for h, j in lists:
            if g == h and i < j and alike(i, j):
                assert got[i] == got[j]
    assert len(set(got.values())) > 3
