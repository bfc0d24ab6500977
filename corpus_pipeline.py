"""Corpus pipeline: the stages that turn documents into token files. Each bounds the batches of the session that it runs in."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, mixing, ngram_join, quality, token_output
from tessera.llm.shared import Workspace, bound_batches, removed_at_end

#: Every leaf at most once, and most of the tokens.
MIX = replace(mixing.PRODUCTION, budget_share=0.9, max_epochs=1)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score below 0.5); texts are not shuffled."""
    bound_batches(spark)
    return quality.keep_good(docs, quality.learning_labels(spark, sf_dir))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each near-duplicate group: five-word shingles, Jaccard similarity 0.8 or more."""
    bound_batches(spark)
    groups = ngram_join.ngram_components(docs, n=5, num=80, den=100)
    extra = groups.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(extra.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    bound_batches(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each leaf's part of the mixture."""
    bound_batches(spark)
    return mixing.keep_mixture(docs, MIX, mixing.source_domain())


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Writes the token files, to path or else to the shared scratch folder, and returns their digest."""
    bound_batches(spark)
    return token_output.encode_documents(docs, path)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("mixing to target weights", target_mixture),
    ("token output", token_files),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Applies the stages to documents, each to what the one before has kept and written, and removes what is no longer read.

    The token files, which the digest is read from, stay: at path, or else in the shared scratch folder.
    """
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with removed_at_end():
            docs = ws.stash(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    out = token_files(spark, docs, sf_dir, path)
    ws.remove()
    return out
