"""Queries of the corpus operators over the shared tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.operators.storage import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, dealt by id where they lie in fewer files than the session runs tasks at once."""
    return spread(table(spark, folder, "documents"), "doc_id")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_token_store")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from quirework.llm.token_store import token_digest

    return token_digest(documents(spark, folder), tokenizer_path("byte_bpe_50k.json"))


@query("op6_quality_rules")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from quirework.llm import rules

    docs = documents(spark, folder)
    trusted = table(spark, folder, "labels").where("quality = 1")
    return rules.judge(docs, rules.fit(docs, trusted))


@query("op1_media_columns")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from quirework.llm.media import media_digest

    return media_digest(documents(spark, folder))


@query("op9_source_mixing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from quirework.llm.mix import mix_digest

    return mix_digest(table(spark, folder, "documents"))


def _chat() -> None:
    from quirework.llm.chat import CHAT_SQL, chat_digest

    query("op5_chat_formatting", CHAT_SQL)(lambda spark, folder: chat_digest(spark, table(spark, folder, "conversations")))


_chat()


@query("op7_sharding")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from quirework.llm.shards import shard_digest

    return shard_digest(table(spark, folder, "documents"))


def _dedup() -> None:
    from quirework.llm.fmindex import DEDUP_SQL, dedup_digest

    query("op8_substring_dedup", DEDUP_SQL)(lambda spark, folder: dedup_digest(documents(spark, folder)))


_dedup()


def _jaccard() -> None:
    from quirework.llm.jaccard import JACCARD_SQL, components

    query("op4_jaccard_join", JACCARD_SQL)(lambda spark, folder: components(documents(spark, folder), n=4, num=85, den=100))


_jaccard()


@query("op2_piece_sampling")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from quirework.llm.pieces import sample_segmentations

    return sample_segmentations(documents(spark, folder), tokenizer_path("piece_bpe_32k.model"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from quirework.llm.quality_model import classify

    return classify(documents(spark, folder), table(spark, folder, "labels"))


def _middle() -> None:
    from quirework.llm.middle import MIDDLE_SQL, middle_digest

    query("op13_fill_in_middle", MIDDLE_SQL)(lambda spark, folder: middle_digest(documents(spark, folder)))


_middle()


@query("op12_embedding_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from quirework.llm.whiten import whiten

    return whiten(table(spark, folder, "embeddings"))


@query("op11_private_data")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from quirework.llm.private import private_digest

    return private_digest(documents(spark, folder))
