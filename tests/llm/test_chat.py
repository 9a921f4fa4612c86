import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.llm import chat as C

RECORDS = [
    ({"messages": [{"role": "human", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, "messages", [("user", "hi"), ("assistant", "yo")]),
    ({"conversations": [{"from": "gpt", "value": "a"}, {"from": "Human", "value": None}]}, "conversations", [("assistant", "a"), ("user", "")]),
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "response": "r"}, "response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"instruction": "do", "input": "x", "output": "y"}, "instruction", [("system", "do"), ("user", "x"), ("assistant", "y")]),
    ({"instruction": "do", "output": "y"}, "task", [("user", "do"), ("assistant", "y")]),
    ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
    ({"turns": [{"role": "x", "text": "t"}]}, "turns", [("x", "t")]),
    ({"something": 1}, None, None),
    ({"messages": []}, None, None),
]


def test_layouts(spark):
    df = spark.createDataFrame([(i, json.dumps(r), 0) for i, (r, _, _) in enumerate(RECORDS)], "id long, j string, fingerprint int").withColumn("record", F.parse_json("j"))
    out = C.format_chats(df, "id", "record")
    rows = {r.id: r for r in out.collect()}
    back = {r.id: r for r in C.read_back(out.where("layout is not null"), "id").collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert rows[i].layout == layout
        if layout:
            assert [tuple(t) for t in back[i].turns] == turns and back[i].learned == "".join(t for r, t in turns if r == "assistant")
        else:
            assert rows[i].formatted is None


def test_nothing_but_spark_expressions(spark):
    df = C.digests(C.read_back(C.format_chats(C.records_of(spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")), "conv_id", "record"), "conv_id"), "conv_id")
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


TEXT = st.text(alphabet=st.sampled_from("\\<>slgturnex/ \nab#é😀"), max_size=20)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=5), min_size=1, max_size=12))
def test_control_strings_come_back(spark, conversations):
    rows = [(i, k, r if k % 2 else "assistant", t) for i, c in enumerate(conversations) for k, (r, t) in enumerate(c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = C.format_chats(C.records_of(df), "conv_id", "record")
    for r in C.digests(C.read_back(formatted, "conv_id"), "conv_id").collect():
        own = [(role, t) for i, _, role, t in rows if i == r.conv_id]
        learned = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    for r in formatted.collect():
        assert sum(x.chars for x in r.loss) == len(r.formatted)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, 2, "user", None), (1, 1, None, "b"), (1, 1, None, "a"), (1, 1, None, "a"), (None, 1, "assistant", "x"), (2, None, "assistant", "y" * 1_000_000)], "conv_id long, turn long, role string, text string")
    out = C.read_back(C.format_chats(C.records_of(df.withColumn("record", F.lit(1))), "conv_id", "record"), "conv_id")
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in got[1].turns] == [("", "a"), ("", "a"), ("", "b"), ("user", "")] and got[None].learned == "x" and len(got[2].learned) == 1_000_000
    assert C.digests(C.read_back(C.format_chats(C.records_of(df.limit(0)), "conv_id", "record"), "conv_id"), "conv_id").count() == 0


@pytest.mark.parametrize("layout", C.LAYOUTS)
def test_fingerprints_differ(layout):
    assert not any(set(layout.shapes()) & set(x.shapes()) for x in C.LAYOUTS if x is not layout)
