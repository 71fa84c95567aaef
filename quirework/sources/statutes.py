"""Statute JSON to text, in Spark SQL: members may be an object, a list, or missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _list(value: Column, path: str) -> Column:
    """A member as an array of variants: a list's items, an object alone, nothing if missing."""
    many = F.try_variant_get(value, path, "array<variant>")
    one = F.try_variant_get(value, path, "variant")
    return F.when(many.isNotNull(), many).when(one.isNotNull() & ~F.is_variant_null(one), F.array(one)).otherwise(F.array().cast("array<variant>"))


def _text(value: Column, path: str) -> Column:
    """A scalar member, or the content of an object that wraps it."""
    plain = F.try_variant_get(value, path, "string")
    wrapped = F.coalesce(*[F.try_variant_get(value, f"{path}.{k}", "string") for k in ("content", "_text", "value", "name")])
    return F.trim(F.coalesce(F.when(F.startswith(plain, F.lit("{")), wrapped).otherwise(plain), F.lit("")))


def _entities(text: Column) -> Column:
    for _ in range(2):
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _filled(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def statute_text(rows: DataFrame, json: str = "json") -> DataFrame:
    """doc_id, name, text of statute payloads (doc_id, json): articles with their 항, 호 and 목 in order, then addenda."""
    v = F.try_parse_json(json)
    body = rows.select("doc_id", v.alias("v"))

    def article(a: Column) -> Column:
        subs = lambda x, key: _list(x, f"$.{key}")
        points = lambda p: F.flatten(F.transform(subs(p, "호"), lambda h: _filled(F.concat(F.array(_text(h, "$.호내용")), F.transform(subs(h, "목"), lambda m: _text(m, "$.목내용"))))))
        paragraphs = F.flatten(F.transform(subs(a, "항"), lambda p: _filled(F.concat(F.array(_text(p, "$.항내용")), points(p)))))
        return F.concat(_filled(F.array(_text(a, "$.조문내용"))), paragraphs)

    articles = F.flatten(F.transform(_list(F.col("v"), "$.법령.조문.조문단위"), article))
    addenda = _filled(F.transform(_list(F.col("v"), "$.법령.부칙.부칙단위"), lambda b: _text(b, "$.부칙내용")))
    appendices = _filled(F.transform(_list(F.col("v"), "$.법령.별표.별표단위"), lambda b: F.coalesce(F.nullif(_text(b, "$.별표내용"), F.lit("")), _text(b, "$.별표제목"))))
    name = _text(F.col("v"), "$.법령.기본정보.법령명_한글")
    return body.select("doc_id", name.alias("name"), _entities(F.array_join(F.concat(articles, addenda, appendices), "\n")).alias("text"))


def appendix_warnings(rows: DataFrame, json: str = "json") -> DataFrame:
    """doc_id, n, titles: appendices of statute payloads that have a title but no text; their title stands for it."""
    items = rows.select("doc_id", F.posexplode(_list(F.try_parse_json(json), "$.법령.별표.별표단위")).alias("k", "v"))
    bare = items.select("doc_id", "k", _text(F.col("v"), "$.별표제목").alias("title"), _text(F.col("v"), "$.별표내용").alias("body")).where("body = ''")
    return bare.groupBy("doc_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]).alias("titles"))


# Fields of a search result, and the size of its pages.
SEARCH_FIELDS = {
    "mst": "법령일련번호", "law_id": "법령ID", "name": "법령명한글", "law_type": "법령구분명", "ministry": "소관부처명", "promulgation_date": "공포일자",
    "promulgation_number": "공포번호", "effective_date": "시행일자", "revision_type": "제개정구분명",
}
PAGE_SIZE = 20


def search_pages(payloads: DataFrame, json: str = "json") -> DataFrame:
    """doc_id, total, page, page_size, error of search answers (doc_id, json); an answer with another code than 00 is an error."""
    v = F.col("_v")
    code = _text(v, "$.LawSearch.resultCode")
    rows = payloads.select("doc_id", F.try_parse_json(json).alias("_v"))
    number = lambda key, default: F.coalesce(F.expr(f"try_cast(try_variant_get(_v, '$.LawSearch.{key}', 'string') AS INT)"), F.lit(default))
    error = F.when(v.isNull(), "not JSON").when((code != "") & (code != "00"), F.concat(F.lit("code "), code))
    return rows.select("doc_id", number("totalCnt", 0).alias("total"), number("page", 1).alias("page"), number("numOfRows", PAGE_SIZE).alias("page_size"), error.alias("error"))


def search_items(payloads: DataFrame, json: str = "json") -> DataFrame:
    """doc_id, place and the fields of each law found; those without number, name or effective date are left out."""
    good = payloads.join(search_pages(payloads, json).where("error is null").select("doc_id"), "doc_id", "left_semi")
    rows = good.select("doc_id", F.posexplode(_list(F.try_parse_json(json), "$.LawSearch.law")).alias("place", "v"))
    items = rows.select("doc_id", "place", *[_text(F.col("v"), f"$.{path}").alias(name) for name, path in SEARCH_FIELDS.items()])
    return items.where("mst <> '' and name <> '' and effective_date <> ''")


def next_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page: the pages of a search that follow the one at hand."""
    last = F.ceil(F.col("total") / F.greatest(F.col("page_size"), F.lit(1))).cast("int")
    return pages.where(F.col("error").isNull() & (last > F.col("page"))).select("doc_id", F.explode(F.sequence(F.col("page") + 1, last)).alias("page"))
