"""The queries of this subpackage, for registration: name -> callable, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, embedding_dedup, html_text, language, licenses, line_dedup, mixing, ngram_join, quality, token_output
from tessera.llm.shared import bound_batches, bound_reads

Query = Callable[[SparkSession, str], DataFrame]


def _bounded(query: Query) -> Query:
    """The query, in a session whose batches are bounded: that of whoever runs registered queries."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def _small_reads(query: Query) -> Query:
    """The query, in a session whose scans are bounded, too: for queries whose executors would hold much besides."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_reads(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_mixing": mixing.op5_mixing,
    "op6_token_output": _small_reads(token_output.op6_token_output),
    "op7_line_dedup": _small_reads(line_dedup.op7_line_dedup),
    "op8_language_id": language.op8_language_id,
    "op9_html_extraction": html_text.op9_html_extraction,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}

QUERIES = {name: _bounded(query) for name, query in QUERIES.items()}

ORACLE_SQL = {
    "op3_embedding_dedup": embedding_dedup.OP3_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op10_ngram_join": ngram_join.OP10_SQL,
}
