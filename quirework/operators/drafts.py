"""Drafts to chunks, results and statuses.

A draft table has (doc_id, draft_no, context, body): context is an array of lines that every chunk of the draft
repeats. draft_no may be any sortable value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import strings as S
from quirework.operators.blocks import claim_mismatches
from quirework.operators.split import split_text


def finalize(drafts: DataFrame, limit: int = S.CHUNK_LIMIT) -> DataFrame:
    """doc_id, draft_no, piece, chunk, n_collisions (separators replaced in the draft; counted with its first piece).

    Only drafts longer than the limit pass through Python.
    """
    context = F.array_join("context", "\n")
    rows = drafts.select("doc_id", "draft_no", S.escape_separator(context).alias("_c"), S.escape_separator(F.col("body")).alias("_b"), (S.count_separators(context) + S.count_separators(F.col("body"))).alias("_n"))
    rows = rows.withColumn("_p", F.when(F.col("_c") == "", "").otherwise(F.concat("_c", F.lit("\n"))))
    rows = rows.withColumn("_room", F.lit(limit) - S.u16_length(F.col("_p")))
    fits = (S.u16_length(F.col("_b")) <= F.col("_room")) | (F.col("_room") < 1)
    short = rows.where(fits).select("doc_id", "draft_no", F.lit(0).alias("piece"), F.concat("_p", "_b").alias("chunk"), F.col("_n").alias("n_collisions"))
    long = rows.where(~fits).withColumn("_s", split_text(F.col("_b"), F.col("_room").cast("int")))
    long = long.select("doc_id", "draft_no", "_p", "_n", F.posexplode("_s").alias("piece", "_t"))
    long = long.select("doc_id", "draft_no", "piece", F.concat("_p", "_t").alias("chunk"), F.when(F.col("piece") == 0, F.col("_n")).otherwise(0).alias("n_collisions"))
    return short.unionByName(long)


def measures(chunks: DataFrame) -> DataFrame:
    """doc_id and the counters of its chunks; texts stay where they are, only lengths and flags are shuffled."""
    n = S.u16_length(F.col("chunk"))
    rows = chunks.select("doc_id", n.alias("n"), S.is_blank(F.col("chunk")).alias("blank"), F.contains("chunk", F.lit(S.SEPARATOR)).alias("left"), "n_collisions")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"), F.max("n").alias("longest_chunk"), (F.sum("n") + (F.count("*") - 1) * len(S.JOINER)).alias("processed_length"),
        F.count_if(F.col("n") > S.CHUNK_LIMIT).alias("over_safe_limit"), F.count_if(F.col("n") > S.CONSUMER_LIMIT).alias("over_consumer_limit"),
        F.count_if("blank").alias("empty_chunks"), F.count_if("left").alias("unresolved_collisions"), F.sum("n_collisions").alias("source_collisions"),
    )


def result_issues(m: dict[str, Column] | None = None) -> Column:
    """array<struct<code, severity, n>> from the counters, in the order of the contract."""
    col = F.col if m is None else m.__getitem__

    def issue(code: str, severity: str, count: Column) -> Column:
        return F.when(count > 0, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), count.cast("long").alias("n")))

    found = F.array(
        issue("empty-result", "error", (col("chunk_count") == 0).cast("int")), issue("empty-chunk", "error", col("empty_chunks")),
        issue("safe-limit-exceeded", "error", col("over_safe_limit")), issue("miso-limit-exceeded", "error", col("over_consumer_limit")),
        issue("unresolved-separator-collision", "error", col("unresolved_collisions")), issue("source-separator-replaced", "warning", col("source_collisions")),
    )
    return F.filter(found, lambda x: x.isNotNull())


COUNTERS = ["chunk_count", "longest_chunk", "processed_length", "over_safe_limit", "over_consumer_limit", "empty_chunks", "unresolved_collisions", "source_collisions"]


def provenance_issues(expected: DataFrame, consumed: DataFrame) -> DataFrame:
    """Issues of documents whose drafts don't account for each source (doc_id, source_id) exactly once."""
    bad = claim_mismatches(expected, consumed)
    return bad.select("doc_id", F.lit("source-block-consumption-mismatch").alias("code"), F.lit("error").alias("severity"), F.col("n"))


def results(docs: DataFrame, chunks: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """One row a document of docs (doc_id): counters, issues, status and can_download; issues (doc_id, code, severity, n) come first."""
    rows = docs.select("doc_id").distinct().join(measures(chunks), "doc_id", "left").na.fill(0, COUNTERS)
    rows = rows.withColumn("issues", result_issues())
    if issues is not None:
        earlier = issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("code", "severity", F.col("n").cast("long").alias("n")))).alias("_i"))
        rows = rows.join(earlier, "doc_id", "left").withColumn("issues", F.concat(F.coalesce("_i", F.array().cast("array<struct<code:string,severity:string,n:bigint>>")), "issues")).drop("_i")
    status = S.severity_status(F.col("issues"))
    return rows.withColumn("status", status).withColumn("can_download", F.col("status") != "blocked")


def serialize(chunks: DataFrame) -> DataFrame:
    """doc_id, processed_text: the chunks in order, joined by the consumer's separator."""
    rows = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("draft_no", "piece", "chunk"))).alias("_c"))
    return rows.select("doc_id", F.array_join(F.transform("_c", lambda x: x["chunk"]), S.JOINER).alias("processed_text"))


def write_texts(chunks: DataFrame, names: DataFrame, path: str) -> None:
    """One text file a document (names: doc_id, name) under path/document=<name>; a rerun replaces the documents it holds.

    A document's folder takes the source's name without its extension, and its id, so that equal names don't meet.
    """
    stem = F.regexp_replace(S.safe_file_name(F.col("name")), r"\.[^.]*\z", "")
    rows = serialize(chunks).join(names.select("doc_id", F.concat(stem, F.lit("-"), F.col("doc_id").cast("string")).alias("document")), "doc_id")
    writer = rows.select("document", F.col("processed_text").alias("value")).repartition("document").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("document").text(path)


def revalidate(edited: DataFrame) -> DataFrame:
    """Results of edited chunks (doc_id, draft_no, chunk): separators are replaced, nothing is split again."""
    rows = edited.select("doc_id", "draft_no", F.lit(0).alias("piece"), S.escape_separator(F.col("chunk")).alias("chunk"), S.count_separators(F.col("chunk")).alias("n_collisions"))
    return results(edited, rows)
