"""From documents to chunks: prepare, route by type, draft, finalize."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import strings as S
from quirework.operators import claims as C
from quirework.operators import contracts, delegation, manuals, sections, workbook
from quirework.operators import drafts as D
from quirework.operators import lines as L
from quirework.operators.storage import cut, temporary
from quirework.sources import files

CHUNKERS = {"general": sections.general_drafts, "law": sections.law_drafts, "manual": manuals.manual_drafts, "excel": workbook.text_drafts}


def raw_documents(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str | None = None, kind: str | None = None) -> DataFrame:
    """doc_id, name, text[, kind] of flat texts; without a name the default one. kind names a column of document types."""
    named = F.coalesce(F.nullif(S.trim(F.col(name)), F.lit("")), F.lit(S.DEFAULT_NAME)) if name else F.lit(S.DEFAULT_NAME)
    more = [S.doc_type(F.coalesce(F.col(kind), F.lit("general"))).alias("kind")] if kind else []
    return rows.select(F.col(doc_id).alias("doc_id"), named.alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more)


def _drafted(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Drafts and issues of several routes; their draft numbers are one struct<pos, region, place, part>."""
    number = F.struct(*[F.col(f"draft_no.{k}").cast("int").alias(k) for k in ("pos", "region", "place", "part")])
    drafts = [d.select("doc_id", number.alias("draft_no"), "context", "body", F.col("sources") if "sources" in d.columns else C.no_sources().alias("sources")) for d, _ in parts]
    return reduce(DataFrame.unionByName, drafts), reduce(DataFrame.unionByName, [i for _, i in parts])


def route_drafts(prepared: DataFrame, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Drafts and issues of prepared docs (doc_id, name, text[, kind]), each row by its kind, or all by the one given.

    Texts of every kind but excel are tried as delegation rules first.
    """
    docs = prepared if kind is None else prepared.withColumn("kind", F.lit(kind))
    own = F.when(F.col("kind").isin(list(CHUNKERS)), F.col("kind")).otherwise("general")
    docs = docs.select("doc_id", "name", "text", own.alias("kind"))
    parts, rest = [], docs
    may = docs.where((F.col("kind") != "excel") & F.contains("text", F.lit(delegation.TITLE)))
    if not may.isEmpty():
        rules, issues, ids = delegation.delegation_drafts(may.select("doc_id", "name", "text"))
        parts.append((rules, issues))
        rest = docs.join(ids, "doc_id", "left_anti")
    kinds = [kind if kind in CHUNKERS else "general"] if kind else [k for k in CHUNKERS if not rest.where(F.col("kind") == k).isEmpty()]
    parts += [CHUNKERS[k](rest.where(F.col("kind") == k).select("doc_id", "name", "text")) for k in kinds or ["general"]]
    return _drafted(parts)


def preprocess(docs: DataFrame, kind: str = "general") -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks (doc_id, draft_no, piece, chunk, n_collisions), issues (doc_id, code, severity, n) and the prepared docs.

    docs may have a column kind, which routes each row; without it all are of the one kind.
    """
    prepared = cut(L.prepare(docs), "prepared")
    drafts, issues = route_drafts(prepared, None if "kind" in docs.columns else kind)
    removed = prepared.where("n_removed > 0").select("doc_id", F.lit("page-decoration-removed").alias("code"), F.lit("warning").alias("severity"), F.col("n_removed").alias("n"))
    return cut(D.finalize(drafts), "chunks"), removed.unionByName(issues), prepared


def preprocess_results(docs: DataFrame, kind: str = "general") -> DataFrame:
    """One row a document; a text that is taken up by no draft, or a line that is lost or doubled, blocks it."""
    chunks, issues, _ = preprocess(docs, kind)
    return D.results(docs, chunks, issues)


def write_results(docs: DataFrame, out: str, kind: str = "general") -> None:
    """Write chunks, results and serialized texts of docs under out; intermediate tables are deleted."""
    with temporary(docs.sparkSession):
        chunks, issues, _ = preprocess(docs, kind)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks")
        D.results(docs, chunks, issues).write.mode("overwrite").parquet(f"{out}/results")
        D.serialize(chunks).write.mode("overwrite").parquet(f"{out}/texts")


def preprocess_blocks(blocks: DataFrame, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """chunks and results of structured general documents (operators.contracts' blocks): contracts, else sections of their text.

    found: further issues (doc_id, code, severity, n), as of a reader.
    """
    blocks = cut(blocks, "blocks")
    drafts, issues, claims = contracts.contract_drafts(blocks)
    drafts, claims = cut(drafts, "contracts"), cut(claims, "claims")
    ids = claims.select("doc_id").distinct()
    rest = contracts.rendered(blocks.join(ids, "doc_id", "left_anti").where(contracts.has_source(F.col("kind"), F.col("text"), F.col("rows"))))
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("# "), "shown")).otherwise(F.col("shown"))
    texts = rest.groupBy("doc_id", "name").agg(F.array_sort(F.collect_list(F.struct("order", "block_id", line.alias("line")))).alias("l"))
    texts = texts.select("doc_id", "name", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("text"))
    both, all_issues = _drafted([(drafts, issues), sections.general_drafts(L.prepare(texts).select("doc_id", "name", "text"))])
    chunks = cut(D.finalize(both), "chunks")
    # Every block that a contract keeps is expected once.
    kept = contracts.articles(blocks).join(ids, "doc_id", "left_semi").select("doc_id", F.col("block_id").alias("source_id"))
    lost = D.provenance_issues(kept, claims.select("doc_id", "source_id"))
    issues = all_issues.unionByName(lost)
    return chunks, D.results(blocks, chunks, issues if found is None else issues.unionByName(found))


def preprocess_word(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks and results of word-processor files (doc_id, name, content); a table too large for a grid blocks its document."""
    blocks, issues = files.placed_blocks(cut(files.document_blocks(docs), "word-blocks"))
    return preprocess_blocks(blocks.select("doc_id", "name", "block_id", "order", "kind", "depth", "ordered", "text", "rows"), issues)
