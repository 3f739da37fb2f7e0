"""Chat formatting: layouts, round trips of the template, and the query against plain Python."""

import collections
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format
from lodestone.llm.chat_format import MAPPINGS, TEMPLATE, Mapping, One


def turns_of(spark, records):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "id long, record string")
    return {r["id"]: (r["mapping"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat_format.canonical(df).collect()}


def test_layouts_become_canonical_turns(spark):
    u, a = ("user", "hi"), ("assistant", "yes")
    s = ("system", "be kind")
    cases = [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]}, "messages", [u, a]),
        ({"id": 7, "meta": {"role": 1}, "system": "be kind", "messages": [{"content": "hi", "role": "user"}]}, "messages", [s, u]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "h"}, {"type": "text", "text": "i"}]}]}, "messages", [u]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}]}, {"role": "assistant", "content": "yes"}]}, "messages", [u, a]),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}, {"from": "tool", "value": ""}]}, "conversations", [u, a, ("tool", "")]),
        ({"turns": [{"turn": 2, "role": "assistant", "text": "yes"}, {"turn": 1, "role": "user", "text": "hi"}]}, "turns", [u, a]),
        ({"instruction": "sum", "input": "1 2", "output": "3"}, "instruction", [("user", "sum\n\n1 2"), ("assistant", "3")]),
        ({"instruction": "sum", "input": "", "output": 3}, "instruction", [("user", "sum"), ("assistant", "3")]),
        ({"prompt": "hi", "completion": "yes", "system": None}, "completion", [u, a]),
        ({"prompt": "hi", "response": "yes"}, "response", [u, a]),
        ({"question": "hi", "answer": "yes", "system": "be kind"}, "question", [s, u, a]),
        ({"prompt": [{"role": "user", "content": "hi"}], "completion": [{"role": "assistant", "content": "yes"}]}, "prompt_messages", [u, a]),
        ({"messages": []}, "messages", []),
        ({"messages": [{"role": "user", "content": None}]}, "messages", [("user", "")]),
        ({"messages": [{"role": "user"}]}, None, None),
        ({"messages": "hi"}, None, None),
        ({"prompt": "hi"}, None, None),
        ({"messages.role": 1, "messages[]": 2}, None, None),
        ({}, None, None),
        ([1], None, None),
        ("not json", None, None),
        (None, None, None),
    ]
    found = turns_of(spark, [r for r, _, _ in cases])
    assert [found[i] for i in range(len(cases))] == [(m, t) for _, m, t in cases]


def test_paths(spark):
    record = {"a": {"b": [1, {"c": None}, []], "d": {}}, "e.f": [[]], "g[]": "x"}
    paths = spark.createDataFrame([(json.dumps(record),)], "r string").select(chat_format.field_paths(F.parse_json("r"))).first()[0]
    assert paths == sorted(["a.b[]", "a.b[].c", "a.b[][]", "a.d{}", "e\\.f[][]", "g\\[\\]"])


def test_unknown_layouts_are_counted(spark):
    df = spark.createDataFrame([('{"prompt": "x"}',), ('{"prompt": "y", "id": 3}',), ('{"question": "x", "answer": "y"}',)], "record string")
    assert [(r["paths"], r["records"]) for r in chat_format.unknown_layouts(chat_format.canonical(df)).collect()] == [(["prompt"], 2)]


def test_two_mappings_of_one_form_are_refused():
    with pytest.raises(ValueError, match="same paths"):
        chat_format.lookup((*MAPPINGS, Mapping("again", ("prompt", "response"), (One("user", "prompt"),))))


def texts(seed=4, n=200):
    r = random.Random(seed)
    pieces = [*TEMPLATE.controls, "\\", "\\\\", "<", "[", "/INST]", "s>", "|start|>", "é", "🎉", "\n", "\r\n", "\t", "a b", "", " ", "\x01", '"', "{}", "$1", "\\n"]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_template_reads_back_what_it_has_written(spark):
    some = texts()
    rows = [(i, [(("user", "assistant", "<|end|>tool\n")[k % 3], some[(i * 7 + k) % len(some)]) for k in range(i % 9)]) for i in range(100)]
    df = spark.createDataFrame(rows, f"id long, turns {chat_format.TURNS}")
    whole, mask = TEMPLATE.formatted(F.col("turns"))
    df = df.select("id", "turns", whole.alias("w"), mask.alias("m"))
    for r in df.select("*", TEMPLATE.turns(F.col("w")).alias("back"), TEMPLATE.learned_text(F.col("w"), F.col("m")).alias("learned")).collect():
        assert r["back"] == r["turns"]
        assert r["learned"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        assert r["w"].count(TEMPLATE.start) == r["w"].count(TEMPLATE.end) == r["w"].count(TEMPLATE.says) == len(r["turns"])
        assert not any(c in r["w"] for c in TEMPLATE.foreign)
        spans = [r["w"][m["first"] : m["last"]] for m in r["m"]]
        assert [re.sub(r"\\(\\?)", r"\1", x) for x in spans] == [t["text"] for t in r["turns"] if t["role"] == "assistant"]


COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def brute(rows):
    held = collections.defaultdict(list)
    for conv, turn, role, text in [*rows, *chat_format.ADDED]:
        held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in held.items():
        turns = [t[2:] for t in sorted(turns)]
        said, learned = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def test_conversations_with_odd_rows(spark, tmp_path):
    some = texts(9)
    rows = [(c, t, ("user", "assistant", "system", "tool", None)[(c + t) % 5], some[(c * 13 + t) % len(some)]) for c in range(40) for t in range(1 + c % 5)]
    rows += [(c, t, ("user", "assistant")[t], f"q{c}{t}" if c % 3 else "") for c in range(50, 90) for t in range(2)]  # pairs
    rows += [(100, 0, "user", None), (100, None, "assistant", "first"), (100, 0, "user", None), (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (101, 0, "user", "x" * 3_000_000), (101, 1, "assistant", "<s>" * 500_000)]
    rows += [(102, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(3000)]
    spark.createDataFrame([(*r, "y") for r in rows], "conv_id long, turn long, role string, text string, turns string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = chat_format.op11_schema_fingerprint(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=lambda r: (r[0] is None, r)) == brute(rows)


def test_all_layouts_are_used(spark, sf_dir):
    rows = chat_format.conversation_turns(spark.read.parquet(f"{sf_dir}/../sf0.01/conversations.parquet"))
    found = chat_format.canonical(chat_format.mixed_records(rows))
    assert {r["mapping"] for r in found.select("mapping").distinct().collect()} >= {"messages", "conversations", "turns", "prompt_messages"}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = chat_format.op11_schema_fingerprint(spark, str(tmp_path)).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in found] == brute([])
