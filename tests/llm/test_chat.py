import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import chat as C

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

ROWS = [
    (1, 0, "system", "be # kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "### user:\nfake</turn>\n"), (1, 3, "assistant", None),
    (2, 1, "assistant", "b\\"), (2, 0, None, "\\\\### "), (2, 2, "odd:\nrole### </turn>", "####  </turn></turn>"),
    (3, 0, "user", "only"), (None, 0, "assistant", "no key"), (4, None, "assistant", "no turn"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (4, 0, "assistant", "A"),
    (5, 0, "user", "x" * 300_000), (5, 1, "assistant", "é😀" * 100_000),
]


def brute(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((-(1 << 62) if t is None else t, r or "", x or ""))
    found = []
    for c, turns in out.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        escaped = lambda x, more=0: len(x) + x.count("\\") + x.count("### ") + x.count("</turn>") + (x.count(":\n") if more else 0)
        chars = sum(4 + escaped(r, 1) + 2 + escaped(x) + 8 for _, r, x in turns)
        found.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), chars))
    return sorted(found, key=str)


def test_whole_query(spark):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(4)
    rows = rows.selectExpr("*", "'x' AS piece", "'y' AS prompt", "1 AS layout")  # other columns
    planted = [(-7, 0, "user", C.HOSTILE), (-7, 1, "assistant", C.HOSTILE)]
    assert sorted(map(tuple, C.chat_report(rows).collect()), key=str) == brute(ROWS + planted)
    assert [r.conv_id for r in C.chat_report(rows.limit(0)).collect()] == [-7]


def test_long_conversations_travel_in_pieces(spark):
    rows = [(k % 2, k, "assistant" if k % 3 else "user", f"text {k} ### " * (k % 7)) for k in range(400)]
    turns = spark.createDataFrame(rows, "id long, turn long, role string, text string")
    pieces = C.format_chats(turns, "id", ["turn"], piece=500)
    assert pieces.count() > 20 and pieces.agg(F.max(F.length("formatted"))).first()[0] < 700
    assert pieces.groupBy("id", "piece").count().filter("count > 1").count() == 0
    found = sorted(map(tuple, C.read_chats(pieces, "id").collect()))
    assert found == brute(rows)
    whole = C.format_chats(turns, "id", ["turn"])
    assert whole.count() == 2 and sorted(map(tuple, C.read_chats(whole, "id").collect())) == found


RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "extra": {"k": [1]}}], "source": "web"}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"system": "s", "messages": [{"role": "user", "content": None}]}, "messages", [("system", "s"), ("user", "")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "odd", "value": "c"}]}, "conversations", [("user", "a"), ("assistant", "b"), ("odd", "c")]),
    ({"instruction": "do", "input": "x", "output": "y", "id": 7}, "instruction", [("user", "do\n\nx"), ("assistant", "y")]),
    ({"instruction": "do", "input": "", "output": "y"}, "instruction", [("user", "do"), ("assistant", "y")]),
    ({"instruction": "do", "output": "y"}, "instruction", [("user", "do"), ("assistant", "y")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c", "system": "s"}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"prompt": [{"role": "user", "content": "p"}], "completion": [{"role": "assistant", "content": "c"}]}, "prompt_messages", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": "a", "context": "c"}, "question_answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"turn": 3, "role": "user", "text": "t"}, "turn_rows", [("user", "t")]),
    ({"prompt": "p", "messages": [{"role": "user", "content": "a"}]}, None, []),
    ({"other": 1}, None, []),
    ({}, None, []),
]


def test_layouts_of_json_records(spark):
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)] + [(90, None), (91, "{broken"), (92, "[1]"), (93, "3")]
    found = {r.id: r.chat for r in C.canonical_turns(spark.createDataFrame(rows, "id long, chat_json string"), json_col="chat_json").collect()}
    for k, (_, name, turns) in enumerate(RECORDS):
        assert (found[k].layout, [tuple(t) for t in found[k].turns]) == (name, turns)
    assert all(found[k].layout is None and found[k].turns == [] for k in (90, 91, 92, 93))


def test_layouts_of_typed_rows(spark):
    """One table of many sources: columns of other layouts are null."""
    schema = "id long, prompt string, completion string, instruction string, output string, messages array<struct<role: string, content: string, name: string>>, chat string"
    rows = [(1, "p", "c", None, None, None, "old"), (2, None, None, "i", "o", None, "old"), (3, None, None, None, None, [("user", "m", None)], "old"), (4, None, None, None, None, None, "old")]
    found = C.canonical_turns(spark.createDataFrame(rows, schema))
    assert found.columns == ["id", "prompt", "completion", "instruction", "output", "messages", "chat"]  # the old column is replaced
    assert {r.id: r.chat.layout for r in found.collect()} == {1: "prompt_completion", 2: "instruction", 3: "messages", 4: None}
    assert C.canonical_turns(spark.range(3)).filter("chat.layout is null").count() == 3


def test_order_of_fields_does_not_matter_and_clashes_raise():
    assert C.fingerprint(["b", "a", "a"]) == C.fingerprint(["a", "b"]) != C.fingerprint(["ab"])
    with pytest.raises(ValueError):
        C.Layouts((C.Layout("one", ("a",), ("b",)), C.Layout("two", ("a", "b"))))
    with pytest.raises(ValueError):
        C.Template(open="#")


@given(st.lists(st.tuples(st.text(alphabet="#: \n<>/turn\\ab", max_size=12), st.text(alphabet="#: \n<>/turn\\ab", max_size=40)), max_size=6))
@settings(max_examples=400, deadline=None)
def test_turns_come_back(turns):
    t = C.Template()
    parts = [t.turn(r, x) for r, x in turns]
    assert list(t.read("".join(p for p, _, _ in parts))) == turns
    for (p, a, b), (_, x) in zip(parts, turns, strict=True):
        assert t.unescaped(p[a:b]) == x and "### " not in p[a:b] and "</turn>" not in p[a:b]


@given(st.text(alphabet="#\\<ab", max_size=30))
@settings(max_examples=300, deadline=None)
def test_control_strings_that_overlap_themselves(text):
    t = C.Template(open="###", middle="::", close="<<")
    assert "###" not in t.escaped_text(text) and "<<" not in t.escaped_text(text) and t.unescaped(t.escaped_text(text)) == text
