"""Records of all layouts in one table, against plain Python; unknown ones have no turns."""

import json

import pytest

from quirework.llm import chat

LONG = "x" * 70_000
CASES = [
    ("messages", {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b\n\"q\" <|end|>"}]}, [("user", "a"), ("assistant", 'b\n"q" <|end|>')]),
    ("messages", {"id": 7, "messages": [{"content": None, "role": "user", "weight": 1}], "meta": {"messages": [1]}}, [("user", None)]),
    ("messages", {"messages": []}, []),
    ("conversations", {"conversations": [{"from": "human", "value": LONG}, {"from": "gpt", "value": ""}, {"from": "tool", "value": "t"}]}, [("user", LONG), ("assistant", ""), ("tool", "t")]),
    ("prompt", {"prompt": "p", "completion": "c", "source": "s"}, [("user", "p"), ("assistant", "c")]),
    ("prompt_response", {"response": "r", "prompt": '[{"role": "user"}]'}, [("user", '[{"role": "user"}]'), ("assistant", "r")]),
    ("question", {"question": "é😀", "answer": None}, [("user", "é😀"), ("assistant", None)]),
    ("instruction", {"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ("instruction_input", {"instruction": "i", "input": "n", "output": "o"}, [("user", "i\n\nn"), ("assistant", "o")]),
    ("instruction_input", {"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ("system_prompt", {"system": "s", "prompt": "p", "completion": "c"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    (None, {"text": "plain"}, None),
    (None, {"prompt": "alone"}, None),
    (None, {"prompt": "p", "completion": "c", "messages": [{"role": "user", "content": "a"}]}, None),
    (None, {"messages": "not a list"}, None),
    (None, {}, None),
    (None, [1, 2], None),
]


def test_mixed_json(spark):
    rows = [(k, json.dumps(record, ensure_ascii=bool(k % 2)), "x") for k, (_, record, _) in enumerate(CASES)]
    rows += [(100, "not json", "x"), (101, None, "x"), (102, "", "x")]
    df = spark.createDataFrame(rows, "id long, record string, messages string").repartition(3)
    got = {r.id: r for r in chat.canonical_turns_json(df, ["id", "messages"], "record").collect()}
    assert len(got) == len(rows)
    for k, (layout, _, turns) in enumerate(CASES):
        assert got[k].layout == layout, CASES[k][1]
        assert (got[k].turns if turns is None else [tuple(t) for t in got[k].turns]) == turns
    assert all(got[k].layout is None and got[k].turns is None for k in (100, 101, 102))


def test_typed_records(spark):
    df = spark.sql("SELECT 1 AS id, 9 AS other, 'p' AS prompt, 'c' AS completion")
    (row,) = chat.canonical_turns(df, ["id"]).collect()
    assert (row.layout, [tuple(t) for t in row.turns]) == ("prompt", [("user", "p"), ("assistant", "c")])
    (row,) = chat.canonical_turns(spark.sql("SELECT 1 AS id, 'p' AS poem"), ["id"]).collect()
    assert row.layout is None and row.turns is None


def conversations(spark):
    rows = []
    for k in range(60):
        roles = [("user", "assistant"), ("system", "user", "assistant"), ("user",), ("user", "assistant", "user", "assistant"), ("human", "gpt"), ("", "tool\n")][k % 6]
        rows += [(k, t, role, f"{role} says {t} \\ <|turn|> \"{k}\" 日本\n\t") for t, role in enumerate(roles)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows


def test_queries_records_take_many_layouts(spark):
    df, rows = conversations(spark)
    out = chat.canonical_turns_json(chat.mixed_records(df), ["conv_id"], "record").collect()
    assert len({r.layout for r in out}) == len(chat.LAYOUTS) and None not in {r.layout for r in out}
    for r in out:
        assert [tuple(t) for t in r.turns] == [(role, text) for k, _, role, text in rows if k == r.conv_id]


def test_format_reads_back(spark):
    df, rows = conversations(spark)
    canonical = chat.canonical_turns_json(chat.mixed_records(df), ["conv_id"], "record")
    out = chat.format_conversations(canonical, ["conv_id"])
    from pyspark.sql import functions as F

    read = out.select("conv_id", "formatted", "mask", chat.parse_turns(F.col("formatted")).alias("turns"), chat.read_loss(chat.parse_turns(F.col("formatted")), F.col("mask")).alias("loss"))
    for r in read.collect():
        own = [(role, text) for k, _, role, text in rows if k == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.loss == "".join(text for role, text in own if role == "assistant")
        assert sum(m.lead + m.loss + m.tail for m in r["mask"]) == len(r.formatted)


@pytest.mark.parametrize("name", list(chat.LAYOUTS))
def test_fingerprints_differ(spark, name):
    marks = {chat.fingerprint(chat._paths(chat._schema(n))) for n in chat.LAYOUTS}
    assert len(marks) == len(chat.LAYOUTS) and chat.fingerprint([*chat._paths(chat._schema(name)), "id", "meta[].x"]) in marks
