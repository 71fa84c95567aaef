"""Documents to sampled pieces in five stages, each written as Parquet and read by the next.

1. rules: documents that the quality rules reject go.
2. near_duplicates: one document of each group linked by five-word shingles at a similarity of 0.8 stays.
3. shared_passages: words of passages that start in an earlier document go; n_chars is counted anew.
4. mix: sources come to their target weights; a document appears as often as the mix takes it, or not at all.
5. pieces: two distinct sampled segmentations of each text.

Edge cases: null, empty and blank texts fail the rules, so they end there. Rows that share a doc_id are rows of their
own in every stage: near_duplicates keeps one row of a group whatever its ids, mix takes them separately. A null doc_id
is never trusted by the rules and neither loses nor takes passages. Empty tables give empty results. Extra columns are
carried to the mix; pieces returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import fmindex, jaccard, mix, pieces, rules
from quirework.llm.queries import documents, tokenizer_path
from quirework.llm.scratch import release, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return rules.keep_good(docs, rules.fit(docs, trusted))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, n=5, num=80, den=100)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fmindex.dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed(docs)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.sample_segmentations(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("shared_passages", shared_passages),
    ("mix", source_mix),
    ("pieces", sampled_pieces),
]

#: Hash buckets, Gumbel draws and systematic rounding aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, codec="zstd")
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
