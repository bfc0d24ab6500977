import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera import storage
from tessera.llm import mixing, ngram_join
from tessera.llm.decontamination import contaminated
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import select_mixture
from tessera.llm.queries import ORACLE_SQL, QUERIES
from tessera.llm.quality import learning_labels, score_quality
from tessera.llm.token_output import read_tokens

SF = "/root/testdata/sf0.001"


def test_registered_queries():
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 11)} and set(ORACLE_SQL) <= set(QUERIES)


def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = docs.cache()
    found = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).cache()
        assert out.columns == columns
        found.append((kept, out))
        kept = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    (a, b), (_, c), (_, d), (_, e) = found
    good = {r.id for r in score_quality(a, learning_labels(spark, SF)).collect() if r.score >= 0.5}
    assert ids(b) == good and len(ids(a)) > len(good) > 0.7 * len(ids(a))
    assert ids(c) == {r.component_id for r in ngram_join.ngram_components(b, n=5, num=80, den=100).collect()}
    assert ids(d) == ids(c) - {r.id for r in contaminated(c, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(e) == {r.id for r in select_mixture(d, corpus_pipeline.MIX, mixing.source_domain()).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for r in e.orderBy("doc_id").collect():
        x = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, e, SF).collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, 0), (3, "some words here " * 30_000, None, "s", 1), (4, "x", "en", "s", 1), (4, "x", "en", "s", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit(1) for k in ("whole", "id", "mix_whole", "text_bytes", "text_copy", "cut", "label", "n", "domain", "component_id")})
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_scratch_goes_and_the_token_files_stay(spark, tmp_path):
    root = Path(storage.shared_root(spark))
    there = set(root.iterdir())
    got = corpus_pipeline.run(spark, SF, str(tmp_path / "ids"))
    assert set(root.iterdir()) == there
    assert sum(len(r.ids) for r in read_tokens(spark, str(tmp_path / "ids")).collect()) == sum(r.n_tokens for r in got.collect())


def test_operators_leave_the_session_as_it_was(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    other = spark.newSession()
    other.conf.set(key, "9999999b")
    before = {k: other.conf.get(k) for k in (key, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.legacy.bucketedTableScan.outputOrdering")}
    docs = other.read.parquet(f"{SF}/documents.parquet").limit(20)
    ngram_join.ngram_components(docs).count()
    dedup_lines(docs).count()
    score_quality(docs, learning_labels(other, SF)).count()
    assert {k: other.conf.get(k) for k in before} == before
    # Registered queries bound the batches of their session.
    QUERIES["op4_license_scan"](other, SF)
    assert other.conf.get(key) == f"{2 << 20}b"
