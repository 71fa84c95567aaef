"""Corpus reports over results: status by language, issues, and chunk length quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_by(results: DataFrame, docs: DataFrame, column: str) -> DataFrame:
    """Documents and chunks by column and status, with subtotals (null column or status)."""
    rows = results.join(docs.select("doc_id", column), "doc_id")
    return rows.rollup(column, "status").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"))


def issue_histogram(results: DataFrame) -> DataFrame:
    return results.select(F.explode("issues").alias("i")).groupBy("i.code", "i.severity").agg(F.count("*").alias("documents"), F.sum("i.n").alias("occurrences"))
