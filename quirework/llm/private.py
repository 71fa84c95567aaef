"""Personal data by bootstrapped contextual extraction.

1. A scan of the texts finds base spans (e-mail and IP addresses, card and phone numbers by their form) and slots: the
   base spans, the seeds, and all other runs that hold digits or an at sign. Each slot has lexical patterns: the two
   words before it, one on either side, the two after it, and a label that stands right before it.
2. Patterns and instances (the values in slots, without their punctuation) form a graph. Rounds of Spark joins score it:
   a pattern's confidence for a kind is the sum of its instances' scores over their number plus one; an instance's
   score is one if it is a seed, else the chance that not all of its confident patterns are wrong.
3. Instances that confident patterns vouch for are found wherever they stand, in a form that their kind may have. Other
   forms of a seed (a phone number without its plus) are found in the same way.

The scan keeps no text. Its regular expressions take time in proportion to a text, however long its words are. What the
rounds shuffle are distinct pairs of pattern and instance, as hashes, added up before they are shuffled.

Edge cases: a null or empty text has no spans. Kinds may overlap; within one kind spans don't. Equal rows get equal
spans; rows that share a doc_id are told apart by their text. A context word counts with its 96 nearest characters. Of
long rows of numbers each is a slot of its own. A table without seeds finds nothing more. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.scratch import if_small, written
from quirework.llm.text import pieces

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 4
#: Distinct instances that must support a pattern, the confidence it needs, and the score an instance needs.
SUPPORT, CONFIDENCE, ACCEPTED = 3, 0.75, 0.75
#: Digit words that one slot may join, and context read on either side.
JOINED, REACH = 5, 96
BROADCAST_ROWS = 200_000

# Possessive forms and lookbehinds keep the leftmost matches and never try a run twice.
_LOCAL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_EMAIL_HERE, _EMAIL = re.compile(_LOCAL), re.compile(r"(?<![A-Za-z0-9._%+-])" + _LOCAL)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++")
_LABELLED = re.compile(r"[^\W\d_]{2,40}[:=]")
_DIGIT_WORD = re.compile(r"[0-9()+./-]++")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_EDGES = "\"'`<>[]{},;:!?*#$%&|="
_HEXTET = re.compile(r"[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){2,}")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, at = [], text.find("@")
    at = 0 if at >= 0 else len(text)
    while at < len(text):
        # A match may begin within a run of characters only where the one before it ended.
        m = (out and out[-1][1] == at and _EMAIL_HERE.match(text, at)) or _EMAIL.search(text, at)
        if not m:
            break
        out.append(m.span())
        at = m.end()
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind (from 1), end of the spans that have the form of their kind."""
    out = [(a, 1, b) for a, b in emails(text)]
    out += [(m.start(), 2, m.end()) for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 3, m.end()))
    out += [(m.start(), 4, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]
    return sorted(out)


def kinds_of(value: str) -> int:
    """A bit for each kind that a value may be of, whatever the base forms say of it."""
    bits = 1 if "@" in value.strip("@") else 0
    digits = _NOT_DIGITS.sub("", value)
    if len(value) >= 7 and len(digits) >= 3 and _HEXTET.fullmatch(value):
        bits |= 2
    if not re.search(r"[^0-9 ().+/-]", value):
        bits |= 4 * (12 <= len(digits) <= 19 and not re.search(r"[().+/]", value)) | 8 * (7 <= len(digits) <= 15 and value.count(".") != 3)
    return bits


def _numbers(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Words, where up to JOINED words of digits with single spaces between them are one."""
    at = 0
    while at < len(words):
        to = at + 1
        if _DIGIT_WORD.fullmatch(text, *words[at]):
            while to < len(words) and words[to][0] == words[to - 1][1] + 1 and text[words[to][0] - 1] == " " and _DIGIT_WORD.fullmatch(text[words[to][0] : words[to][1]].rstrip(".,;:!?)")):
                to += 1
                if text[words[to - 1][1] - 1] in ".,;:!?":
                    break
        if to - at <= JOINED:
            yield words[at][0], words[to - 1][1]
        else:
            yield from words[at:to]
        at = to


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs with digits or an at sign that meet no base span, without labels and punctuation around them."""
    taken, k = sorted((a, b) for a, _, b in base), 0
    words = []
    reached = 0
    for m in _WORD.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reached = max(reached, taken[k][1])
            k += 1
        if reached <= m.start():
            words.append(m.span())
    for a, b in _numbers(text, words):
        m = _LABELLED.match(text, a, b)
        a = m.end() if m else a
        while a < b and text[a] in _EDGES:
            a += 1
        while b > a and text[b - 1] in _EDGES + ".":
            b -= 1
        if text.count(")", a, b) > text.count("(", a, b) and text[b - 1] == ")":
            b -= 1
        if b - a >= 5:
            yield a, b


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def patterns(text: str, a: int, b: int) -> list[int]:
    """Hashes of a slot's contexts; words in lower case, the ends of the text as words of their own."""
    before, after = text[max(0, a - REACH) : a], text[b : b + REACH]
    m = re.search(r"([^\W\d_]{2,40})[:=#][\"'`(<\[]*\Z", before)
    left = ["^", "^", *before.lower().split()][-2:]
    right = [*after.lower().split(), "$", "$"][:2]
    out = [_hash("LL", *left), _hash("LR", left[1], right[0]), _hash("RR", *right)]
    if not m:
        m = re.search(r"([^\W\d_]{2,40})[:=#]\s{1,4}[\"'`(<\[]*\Z", before)
    return [*out, _hash("label", m[1].lower())] if m else out


def value_of(text: str) -> str:
    return text.lower() if re.search(r"[^0-9 ().+/-]", text) or text.count(".") == 3 else _NOT_DIGITS.sub("", text)


_SLOT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("kinds", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))])
_SCAN = "doc_id long, text_key long, slots array<struct<start:int,end:int,kind:int,kinds:int,value:long,patterns:array<long>>>"


def slots_of(text: str) -> list[tuple]:
    if not re.search("[0-9@]", text):
        return []
    base = base_spans(text)
    found = [(a, b, kind) for a, kind, b in base] + [(a, b, 0) for a, b in candidates(text, base)]
    return [(a, b, kind, 1 << kind - 1 if kind else kinds_of(text[a:b]), _hash(value_of(text[a:b])), patterns(text, a, b)) for a, b, kind in found]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _SLOT]
    for part, _, _ in pieces(batches):
        slots = [[dict(zip(names, s, strict=True)) for s in slots_of(t)] for t in part.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(slots, pa.list_(_SLOT))], ["doc_id", "text_key", "slots"])


def scan(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, text_key, slots. kind is 0 outside of base spans; kinds has a bit a kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(_scan, _SCAN)


def _each(make) -> list[Column]:
    return [make(k, f"s{k}") for k in range(1, len(KINDS) + 1)]


def score(scanned: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confident patterns (pattern, kind, confidence) and instances with their scores (value, s1 to s4, seed1 to seed4)."""
    c = F.col
    slots = scanned.select(F.inline("slots"))
    seeds = [F.max((c("kind") == k).cast("double")).alias(s) for k, s in zip(range(1, 5), ("seed1", "seed2", "seed3", "seed4"), strict=True)]
    instances = slots.groupBy("value").agg(*seeds)
    instances = written(instances.select("*", *[c(f"seed{k}").alias(f"s{k}") for k in range(1, 5)]), "instances")
    edges = slots.select(F.explode("patterns").alias("pattern"), "value", "kinds").groupBy("pattern", "value").agg(F.bit_or("kinds").alias("kinds"))
    edges = written(edges, "edges")
    good, n_good = None, -1
    for _ in range(rounds):
        scored = edges.join(instances.select(c("value").alias("_v"), "s1", "s2", "s3", "s4"), c("value") == c("_v")).drop("_v")
        sums = _each(lambda k, s: F.sum(s).alias(f"t{k}")) + _each(lambda k, s: F.count_if(c(s) >= ACCEPTED).alias(f"n{k}"))
        found = scored.groupBy("pattern").agg(F.count("*").alias("n"), *sums)
        best = F.array_max(F.array(*[F.struct((c(f"t{k}") / (c("n") + 1)).alias("confidence"), F.lit(-k).alias("k"), c(f"n{k}").alias("support")) for k in range(1, 5)]))
        found = found.withColumn("b", best).where((c("b.confidence") >= CONFIDENCE) & (c("b.support") >= SUPPORT))
        good = written(found.select("pattern", (-c("b.k")).alias("kind"), "b.confidence"), "patterns")
        n = good.count()
        vouched = edges.join(if_small(good.withColumnRenamed("pattern", "_p"), BROADCAST_ROWS), c("pattern") == c("_p")).where(F.expr("kinds & shiftleft(1, kind - 1)") != 0)
        miss = [F.sum(F.when(c("kind") == k, F.log1p(-c("confidence")))).alias(f"m{k}") for k in range(1, 5)]
        vouched = vouched.groupBy(c("value").alias("_v")).agg(*miss)
        new = instances.join(vouched, c("value") == c("_v"), "left")
        own = [F.greatest(c(f"seed{k}"), F.coalesce(1 - F.exp(f"m{k}"), F.lit(0.0))).alias(f"s{k}") for k in range(1, 5)]
        instances = written(new.select("value", "seed1", "seed2", "seed3", "seed4", *own), "instances")
        if n == n_good:
            break
        n_good = n
    return good, instances


def found_spans(scanned: DataFrame, instances: DataFrame) -> DataFrame:
    """doc_id, text_key, found (array of start, kind, end) of the documents in which accepted instances stand outside of base spans."""
    c = F.col
    each = [F.when(c(f"s{k}") >= ACCEPTED, F.struct(c(f"s{k}").alias("score"), F.lit(-k).alias("k"), F.lit(1 << k - 1).alias("bit"))) for k in range(1, 5)]
    accepted = instances.select(c("value").alias("_v"), F.filter(F.array(*each), lambda x: x.isNotNull()).alias("as")).where(F.size("as") > 0)
    slots = scanned.select("doc_id", "text_key", F.inline("slots")).where("kind = 0 and kinds <> 0").drop("patterns")
    rows = slots.join(accepted, c("value") == c("_v"))
    best = F.array_max(F.filter("as", lambda x: c("kinds").bitwiseAND(x["bit"]) != 0))
    rows = rows.withColumn("_b", best).where("_b is not null")
    return rows.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", (-c("_b.k")).alias("kind"), "end")).alias("found"))


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """A row a document: doc_id, text_key, base and spans: arrays of start, kind (from 1) and end, by start and kind."""
    c = F.col
    scanned = written(scan(docs), "slots")
    _, instances = score(scanned, rounds)
    found = written(found_spans(scanned, instances), "found").select(c("doc_id").alias("_d"), c("text_key").alias("_t"), "found")
    base = F.array_sort(F.transform(F.filter("slots", lambda x: x["kind"] > 0), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    rows = scanned.select("doc_id", "text_key", base.alias("base")).join(found, c("doc_id").eqNullSafe(c("_d")) & (c("text_key") == c("_t")), "left")
    spans = F.when(c("found").isNull(), c("base")).otherwise(F.array_sort(F.concat("base", F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int>>")))))
    return rows.select("doc_id", "text_key", "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs with their spans replaced in text by the kind's name in angle brackets; overlapping spans go as one."""
    c = F.col
    spans = find(docs, rounds).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"]).select(c("doc_id").alias("_d"), c("text_key").alias("_t"), "spans")
    # The input's columns travel as one, so that their names can't clash with those added here.
    whole = docs.select(F.struct("*").alias("row"), c("doc_id").cast("long").alias("_id"), F.coalesce(c("text").cast("string"), F.lit("")).alias("_text"))
    rows = whole.join(spans, c("_id").eqNullSafe(c("_d")) & (F.xxhash64("_text") == c("_t")), "left")

    def step(done: Column, x: Column) -> Column:
        name = F.concat(F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), x["kind"]), F.lit(">"))
        clear = F.concat(done["out"], F.array(F.substring(c("_text"), done["at"] + 1, x["start"] - done["at"]), name))
        return F.when(x["start"] < done["at"], F.struct(F.greatest(done["at"], x["end"]).alias("at"), done["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), clear.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.aggregate("spans", start, step, lambda d: F.array_join(F.concat(d["out"], F.array(F.substring(c("_text"), d["at"] + 1, F.char_length("_text")))), ""))
    rows = rows.withColumn("_clean", F.when(c("spans").isNull(), c("row.text")).otherwise(text))
    return rows.select(*[c("_clean").alias("text") if k == "text" else c(f"row.`{k}`").alias(k) for k in docs.columns])


def private_digest(docs: DataFrame) -> DataFrame:
    """Counts and a hash of the base spans, and all spans of every row."""
    rows = find(docs)
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS, 1)]
    return rows.select("doc_id", *counts, F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
