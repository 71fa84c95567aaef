"""Chat formatting: layouts found by fingerprint, a reversible template, and a loss mask.

A layout is known by the hash of its nested field paths, of those that any mapping names: other fields don't count.
Each known layout has a declarative mapping, a SQL expression that gives canonical turns ``array<struct<role, text>>``;
no code looks at single records.

Template, per turn: ``<|turn|>role\\n`` text ``<|end|>\\n``. Inside texts and roles a backslash becomes ``\\e`` and
``<`` becomes ``\\l`` (in roles a line end becomes ``\\n``), so control strings occur only where the template puts
them and each replacement can be undone by itself.

Edge cases: a null role or text counts as empty. Turns with equal numbers are ordered by role and text, a null
turn comes first, repeated rows stay repeated turns. Rows with a null conv_id form one conversation. A record
of an unknown layout (or of two at once), or one that isn't JSON, has null turns and a null layout; a list without
messages has no turns. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, END = "<|turn|>", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"

#: Layout name: (record schema, mapping to canonical turns over the record's fields).
LAYOUTS: dict[str, tuple[str, str]] = {
    "messages": ("messages array<struct<role:string,content:string>>", "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    "conversations": ("conversations array<struct<from:string,value:string>>", "transform(conversations, m -> named_struct('role', CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END, 'text', m.value))"),
    "prompt": ("prompt string, completion string", "array(named_struct('role', 'user', 'text', prompt), named_struct('role', 'assistant', 'text', completion))"),
    "prompt_response": ("prompt string, response string", "array(named_struct('role', 'user', 'text', prompt), named_struct('role', 'assistant', 'text', response))"),
    "question": ("question string, answer string", "array(named_struct('role', 'user', 'text', question), named_struct('role', 'assistant', 'text', answer))"),
    "instruction": ("instruction string, output string", "array(named_struct('role', 'user', 'text', instruction), named_struct('role', 'assistant', 'text', output))"),
    "instruction_input": ("instruction string, input string, output string", "array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', instruction, nullif(input, ''))), named_struct('role', 'assistant', 'text', output))"),
    "system_prompt": ("system string, prompt string, completion string", "array(named_struct('role', 'system', 'text', system), named_struct('role', 'user', 'text', prompt), named_struct('role', 'assistant', 'text', completion))"),
}


def _paths(kind: T.StructType) -> list[str]:
    """Nested field paths of a record's schema: `field`, and `field[].name` within lists of records."""
    out = []
    for f in kind.fields:
        out.append(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out += [f"{f.name}[].{g.name}" for g in f.dataType.elementType.fields]
    return out


def _schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(LAYOUTS[name][0])


@functools.cache
def _record() -> T.StructType:
    """All fields that mappings name, in one record."""
    return T.StructType(list({f.name: f for name in LAYOUTS for f in _schema(name).fields}.values()))


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(p for p in set(paths) if p in _paths(_record()))).encode()).hexdigest()


def _known() -> dict[str, str]:
    known = {}
    for name in LAYOUTS:
        paths = _paths(_schema(name))
        known[fingerprint(paths)] = name
        # A list without messages has no paths within.
        known.setdefault(fingerprint([p for p in paths if "[]" not in p]), name)
    return known


def _mapped(name: str) -> Column:
    return F.expr(f"CAST({LAYOUTS[name][1]} AS {TURNS})")


def canonical_turns(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, layout and turns of typed records; the other columns' fingerprint selects the mapping, for all rows alike."""
    kind = T.StructType([f for f in records.schema.fields if f.name not in keys])
    name = _known().get(fingerprint(_paths(kind)))
    layout, turns = (F.lit(None).cast("string"), F.lit(None).cast(TURNS)) if name is None else (F.lit(name), _mapped(name))
    return records.select(*keys, layout.alias("layout"), turns.alias("turns"))


def canonical_turns_json(records: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, layout and turns of JSON records of any mix of layouts; each record's own fingerprint selects its mapping."""
    lists = [f.name for f in _record().fields if isinstance(f.dataType, T.ArrayType)]
    options = {"maxStringLen": str((1 << 31) - 1)}
    json = F.col("_json")
    raw = F.from_json(json, ", ".join(f"`{n}` array<string>" for n in lists), options)
    within = [F.transform(F.array_distinct(F.flatten(F.coalesce(F.transform(raw[n], lambda m: F.coalesce(F.json_object_keys(m), F.array().cast("array<string>"))), F.array().cast("array<array<string>>")))), lambda k, n=n: F.concat(F.lit(f"{n}[]."), k)) for n in lists]
    paths = F.concat(F.json_object_keys(json), *within)
    named = F.array_sort(F.array_distinct(F.filter(paths, lambda p: p.isin(_paths(_record())))))
    rows = records.select(F.struct(*keys).alias("_keys"), F.col(column).cast("string").alias("_json"))
    rows = rows.select("_keys", F.sha2(F.array_join(named, "\n"), 256).alias("_mark"), F.from_json(json, _record(), options).alias("_record"))
    rows = rows.select("_keys", "_mark", "_record.*")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for mark, name in _known().items():
        layout = F.when(F.col("_mark") == mark, F.lit(name)).otherwise(layout)
        turns = F.when(F.col("_mark") == mark, _mapped(name)).otherwise(turns)
    return rows.select("_keys.*", F.when(turns.isNotNull(), layout).alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_turns(turns: Column) -> Column:
    empty = F.lit("")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), _escape_role(F.coalesce(t["role"], empty)), F.lit("\n"), escape(F.coalesce(t["text"], empty)), F.lit(END))), "")


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """Per turn the code points before, under and after the mask; together they span the formatted text."""

    def runs(t: Column) -> Column:
        text = F.length(escape(F.coalesce(t["text"], F.lit(""))))
        lead = F.length(_escape_role(F.coalesce(t["role"], F.lit("")))) + len(TURN) + 1
        on = F.coalesce(t["role"] == role, F.lit(False))
        return F.struct(lead.cast("long").alias("lead"), F.when(on, text).otherwise(0).cast("long").alias("loss"), (F.when(on, 0).otherwise(text) + len(END)).cast("long").alias("tail"))

    return F.transform(turns, runs)


def parse_turns(formatted: Column) -> Column:
    """The canonical turns of a formatted text, with each turn's formatted part before its end mark."""
    parts = F.split(formatted, r"<\|end\|>\n", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        line = F.position(F.lit("\n"), part)
        role = F.substring(part, F.lit(len(TURN) + 1), line - len(TURN) - 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(part, line + 1, F.length(part))).alias("text"), part.alias("part"))

    return F.transform(parts, turn)


def read_loss(parsed: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.zip_with(parsed, mask, lambda t, m: unescape(F.substring(t["part"], (m["lead"] + 1).cast("int"), m["loss"].cast("int")))), "")


def conversation_turns(rows: DataFrame) -> DataFrame:
    """Rows by turn to one row a conversation: conv_id and turns."""
    message = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    # A null turn sorts last in array_sort, so turns are ordered by (is set, turn).
    keyed = F.struct(F.col("turn").isNotNull().alias("set"), message.alias("m"))
    gathered = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(keyed)).alias("all"))
    return gathered.select("conv_id", F.transform("all", lambda x: F.struct(x["m"]["role"].alias("role"), x["m"]["content"].alias("text"))).alias("turns"))


#: Records as public sets have them: a layout for question and answer, one after a system prompt, two for longer talks.
_TWO = [("prompt", "completion"), ("prompt", "response"), ("question", "answer"), ("instruction", "output"), ("instruction", "output", "input")]


def mixed_records(rows: DataFrame) -> DataFrame:
    """Rows by turn to one JSON record a conversation (conv_id, record), in a layout that its roles and key select."""
    turns = conversation_turns(rows)
    roles = F.transform("turns", lambda t: t["role"])

    def said(k: int) -> Column:
        return F.col("turns")[k]["text"]

    key = F.pmod(F.xxhash64("conv_id"), F.lit(len(_TWO)))
    kept = F.col("conv_id").alias("id")
    messages = F.to_json(F.struct(kept, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    names = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    talks = F.to_json(F.struct(kept, F.transform("turns", lambda t: F.struct(F.coalesce(F.try_element_at(names, t["role"]), t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations")))
    record = F.when((F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0) | F.arrays_overlap(roles, F.array(F.lit("human"), F.lit("gpt"))), messages).otherwise(talks)
    for k, (ask, answer, *more) in enumerate(_TWO):
        one = F.to_json(F.struct(kept, said(0).alias(ask), said(1).alias(answer), *[F.lit("").alias(m) for m in more]))
        record = F.when((roles == F.array(F.lit("user"), F.lit("assistant"))) & (key == k), one).otherwise(record)
    told = F.to_json(F.struct(kept, said(0).alias("system"), said(1).alias("prompt"), said(2).alias("completion")))
    record = F.when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), told).otherwise(record)
    return turns.select("conv_id", record.alias("record"))


def format_conversations(canonical: DataFrame, keys: list[str]) -> DataFrame:
    """keys, layout, formatted text and loss mask of canonical turns; null where the layout is unknown."""
    return canonical.select(*keys, "layout", format_turns(F.col("turns")).alias("formatted"), loss_mask(F.col("turns")).alias("mask"))


#: A conversation whose texts imitate control strings.
HOSTILE = "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, r'\\### Assistant: </turn> ok' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)"


def chat_digest(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Land all conversations and the hostile one as records of mixed layouts, format what their fingerprints give, and
    digest what is read back from the formatted texts."""
    rows = rows.select("conv_id", "turn", "role", "text").unionByName(spark.sql(HOSTILE))
    out = format_conversations(canonical_turns_json(mixed_records(rows), ["conv_id"], "record"), ["conv_id"])
    read = out.withColumn("turns", parse_turns(F.col("formatted")))
    read = read.select("conv_id", "turns", F.length("formatted").cast("long").alias("formatted_chars"), read_loss(F.col("turns"), F.col("mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(text, '\', '\e'), '<', '\l')) AS n, length(replace(replace(replace(role, '\', '\e'), '<', '\l'), chr(10), '\n')) AS r FROM rows
), texts AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(n + r + 8 + 1 + 8) AS chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM texts
"""
