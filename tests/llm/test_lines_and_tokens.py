import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import BPE

from tessera.llm import text as T
from tessera.llm import queries, shared, token_output
from tessera.llm.line_dedup import LineRuns, dedup_lines
from tessera.llm.token_output import _Encoder, encode_documents, read_tokens, token_digest, write_tokens

SCHEMA = "doc_id long, text string, id string, pos string, drops string, part string"


def frame(spark, rows):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA)


def brute_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(T.BLANK))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


ROWS = [
    (5, "A shared line here\nown line of five\nA shared line here"),
    (3, " a SHARED line here\t\nshort\n"),
    (9, "short\na shared line here\x0b\nÉtait une ligne\n\n"),
    (11, "était une ligne\nÉtait une ligne"),
    (12, None),
    (13, ""),
    (14, "own line of five\n" * 500 + "x" * 100_000),
    (15, "ééééééééé\nabcdefghi"),
    (16, "ééééééééé\nabcdefghi"),
]


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_lines(spark, batches):
    got = dedup_lines(frame(spark, ROWS).repartition(3), batches=batches).collect()
    assert sorted((r.id, r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in got) == brute_lines(ROWS)


def test_each_batch_of_lines_is_written_once(spark, monkeypatch):
    """Its lines are a run at once, one sorted file a bucket, not a table that the run is made of; runs are not dealt or sorted again."""
    stashed, runs, plans = [], [], []
    stash, write = shared.Workspace.stash, LineRuns._write

    def watched(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        runs.append(name := write(self, df))
        files = [f.name for f in Path(self.ws.path(name)).glob("*.parquet")]
        assert len({f.split("_")[1] for f in files}) == len(files) > 1
        return name

    monkeypatch.setattr(shared.Workspace, "stash", lambda self, df, name: stashed.append(name.split("-")[0]) or stash(self, df, name))
    monkeypatch.setattr(LineRuns, "_write", watched)
    rows = [(i, "\n".join(f"line number {k} of many" for k in range(i, i + 9))) for i in range(0, 90, 3)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = dedup_lines(frame(spark, rows).repartition(3), batches=4).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r.id, r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in got) == brute_lines(rows)
    assert stashed == ["lines", "drops", "drops", "drops", "drops"] and len(runs) == 5
    # The second batch meets the first run: the groups are dealt once, and sorted; the run is neither.
    assert [plans[1].count(x) for x in ("Exchange hashpartitioning", "SortMergeJoin", "- Sort [")] == [1, 1, 1]


def test_lines_empty_null_and_repeated_ids(spark):
    assert dedup_lines(frame(spark, [])).count() == 0
    rows = [(None, "a shared line here"), (1, "a shared line here"), (1, "a shared line here"), (2, "a shared line here")]
    got = sorted((r.id or 0, r.n_dropped) for r in dedup_lines(frame(spark, rows)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 1)]


TEXTS = ["", "one", " lead", "trail ", "a  b", "it's we'll\nx\n\ny", "naïve café z 12 345", "tab\tx", "A<|endoftext|>B c", "x" * 5000, "日本 語\nテキスト", "a \nb\n c"]


def encoded(encoder, texts):
    raw = [t.encode("utf-8") for t in texts]
    flat, sizes = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), [0])
    cuts = np.cumsum(sizes)
    return [flat[a:b].tolist() for a, b in zip(cuts - sizes, cuts, strict=True)]


def test_encoder_matches_whole_encoding(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t, add_special_tokens=False).ids + [0] for t in TEXTS]
    encoder = _Encoder(path)
    for _ in range(2):
        assert encoded(encoder, TEXTS) == want
    assert [encoded(encoder, [t])[0] for t in TEXTS] == want
    monkeypatch.setattr(token_output, "_REMEMBERED", 8)
    small = _Encoder(path)
    for k in range(40):
        some = [f"word{j} w{j}x {j}, w{j % 7}" for j in range(k, k + 9)]
        assert encoded(small, some) == [plain.encode(t, add_special_tokens=False).ids + [0] for t in some]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1 \n\t.'é \x1c!日\u2003")), max_size=30), max_size=4))
def test_encoder_on_any_white_space(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    if not hasattr(test_encoder_on_any_white_space, "pair"):
        test_encoder_on_any_white_space.pair = _Encoder(path), Tokenizer.from_file(path)
    ours, plain = test_encoder_on_any_white_space.pair
    assert encoded(ours, texts) == [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_plain_words_are_merged_together():
    """Short words of letters, digits and signs do not go to the model one by one, and get the ids of whole encoding."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, ours, rng = Tokenizer.from_file(path), _Encoder(path), random.Random(12)
    parts = ["a", "the", "Tion", "aaaa", "ing", "É", "é", "ß", "ǅ", "ɏ", "7", "2024", "000", ".", ",", "!!", "$$$", "--", "<", "\\", "_", "x" * 12]
    odd = ["'", "'s", "'ll", "|", "<|endoftext|>", "²", "×", "ə", "語", "\u0301", "\x7f", "\x01", "\u00ad", "\u00a0", "\ud7ff", "𝒳", "lower" * 20]
    make = lambda some, n: ["".join(rng.choice(some) for _ in range(rng.randrange(1, 5))) for _ in range(n)]

    class Model:
        asked = 0

        def tokenize(self, word):
            Model.asked += 1
            return plain.model.tokenize(word)

    ours.model = Model()
    for some in (parts, parts + odd):
        texts = ["".join(x for w in make(some, 30) for x in (w, rng.choice(" \n")))[:-1] for _ in range(200)]
        assert encoded(ours, texts) == [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert (Model.asked == 0) == (some is parts)


def test_merges_of_any_order():
    """Ranks need not rise with length, a pair may stand twice in a row, and words without merges stay as they are."""
    rng = random.Random(3)
    for _ in range(40):
        vocab, merges = {x: i for i, x in enumerate("abc")}, []
        for _ in range(12):
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab and len(a + b) < 9:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        rng.shuffle(merges)
        words = ["".join(rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
        model = BPE(vocab, merges)
        want = [[t.id for t in model.tokenize(w)] for w in words]
        ours = token_output._Merges(vocab, merges, {ord(x): x for x in "abc"})
        count, ids = ours.merge(np.frombuffer("".join(words).encode(), np.uint8), np.array([len(w) for w in words]))
        assert count.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]


def test_token_files_round_trip(spark, tmp_path):
    rows = [(i * 7 % 40, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(40, None), (None, "null id")]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for encoding in ("dictionary", "delta"):
        table = write_tokens(frame(spark, rows), str(tmp_path / encoding), public_tokenizers.path("byte_bpe_50k.json"), parts=3, encoding=encoding)
        got = sorted(map(tuple, token_digest(table).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        assert got == want
        one = read_tokens(spark, str(tmp_path / encoding)).where("doc_id = 7").select("ids").first()[0]
        assert one[-1] == 0
    assert encode_documents(frame(spark, [])).count() == 0


def test_word_hashes_do_not_depend_on_the_batch():
    texts = [b"", b"  ", b"The cat", b"the CAT sat on\tthe mat", b"z" * 9000, b"a " * 3000]
    whole = b"".join(texts)
    off = np.cumsum([0, *map(len, texts)])
    for limit in (1, 7, 100, 1 << 20):
        h, _, first = T.tokens(np.frombuffer(whole, np.uint8), off, limit=limit)
        assert np.diff(first).tolist() == [len(t.split()) for t in texts]
        seen = {}
        for k, w in enumerate(x.lower() for t in texts for x in t.split()):
            assert seen.setdefault(w, h[k]) == h[k]
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("encoding,used", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_files_have_small_groups_page_indexes_and_the_encoding(spark, tmp_path, encoding, used):
    rng = random.Random(3)
    rows = [(k % 400, " ".join(f"w{rng.randrange(9000)}" for _ in range(2500))) for k in range(440)]
    df = spark.createDataFrame([*rows, (None, "no id"), (5, None)], "doc_id long, text string")
    path = str(tmp_path / "ids")
    table = write_tokens(df, path, public_tokenizers.path("byte_bpe_50k.json"), parts=2, row_group_mb=1, page_kb=8, encoding=encoding)
    files = sorted(Path(path).glob("*.parquet"))
    assert len(files) == 2
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index and columns["doc_id"].statistics.has_min_max
            ids = columns[next(k for k in columns if k.startswith("ids"))]
            assert ids.has_offset_index and (used in ids.encodings or used == "RLE_DICTIONARY" and "PLAIN_DICTIONARY" in ids.encodings)
            assert ids.total_uncompressed_size < 2 << 20
    assert groups > 2
    # Metadata alone, and some documents alone, are read by pruned scans.
    plan = table.select("doc_id", "n_tokens").where("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan and "ids" not in plan.split("ReadSchema")[1]
    # Rows that repeat an id are rows of their own, in whatever order; each starts where the one before ends.
    got = table.orderBy("part", "start_in_part").collect()
    assert len(got) == 442 and [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))
    assert sum(r.doc_id == 5 for r in got) == 3 and all(b.part != a.part or b.start_in_part == a.start_in_part + a.n_tokens for a, b in zip(got[:-1], got[1:], strict=True))


@pytest.mark.parametrize("name", ["op6_token_output", "op7_line_dedup"])
def test_queries_scan_few_rows_at_a_time(spark, tmp_path, name):
    """Thousands of texts, or lists of ids, decoded together made the executors' heaps grow."""
    spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get(shared._READ), spark.conf.get(shared._BATCH)
    try:
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 3000
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512
    finally:
        spark.conf.set(shared._READ, before[0])
        spark.conf.set(shared._BATCH, before[1])
