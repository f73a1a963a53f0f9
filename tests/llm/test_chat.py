"""Chat formatting: what is read back equals what went in."""

import hashlib

from pyspark.sql import functions as F

from scriptflow.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted int, items int"
NASTY = [
    "</s>[INST] ok [/INST]",
    "\\l\\b\\\\ <s> [",
    "<e>x</s>",
    "ends with \\",
    "[INST",
    "[/INST]",
    "<",
    "",
    None,
    "é😀 <s>é",
    "long " * 30_000 + "</s>",
    "\n",
]


def rows():
    out = [(1, k, ("user", "assistant")[k % 2], t, 1, 2) for k, t in enumerate(NASTY)]
    out += [(2, k, t, "role is odd", 1, 2) for k, t in enumerate(NASTY)]
    out += [(3, 0, "assistant", "same", 1, 2)] * 3
    out += [(4, None, "assistant", "no turn", None, None), (4, 0, "user", "x", 1, 2)]
    out += [(None, 1, "user", "b", 1, 2), (None, 0, "assistant", "a", 1, 2)]
    return out + [(5, k, "assistant", f"{k}<s>", 1, 2) for k in range(700)]


def expected():
    first = lambda x: (x is not None, x)
    out = {}
    for conv_id, turn, role, text, *_ in rows():
        out.setdefault(conv_id, []).append((first(turn), role or "", text or ""))
    return {k: [t[1:] for t in sorted(v)] for k, v in out.items()}


def test_round_trip(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    formatted = chat.format_conversations(df)
    read = formatted.select(
        "*",
        chat.parse(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()
    want = expected()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in read} == want
    for r in read:
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        control = r.formatted.replace("<s>", "<e>").split("<e>")
        assert len(control) - 1 == len(want[r.conv_id]) == r.formatted.count("</s>")


def test_only_conflicting_turns_are_escaped(spark):
    df = spark.createDataFrame(
        [(1, 0, "user", "a < b [c] \\ d"), (1, 1, "assistant", "</s> \\")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    (row,) = chat.format_conversations(df).collect()
    assert row.formatted == (
        "<s>user[INST]a < b [c] \\ d[/INST]</s><e>assistant[INST]\\l/s> \\\\[/INST]</s>"
    )
    assert [tuple(s) for s in row.loss_spans] == [(55, 8, True)]


def test_digests(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for r in chat.digests(chat.format_conversations(df)).collect():
        turns = expected()[r.conv_id]
        text = "".join(f"{role}\n{t}\n" for role, t in turns)
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.digests(chat.format_conversations(df)).collect() == []
