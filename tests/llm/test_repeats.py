"""Suffix arrays against sorting, removal of repeats against a dictionary of strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptflow.llm import repeats
from scriptflow.llm.suffixes import suffix_array

SCHEMA = "doc_id bigint, text string, anchor int, bytes int, kept int"


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for turn in range(3000):
        text = [rng.randrange(rng.randrange(1, 5)) for _ in range(rng.randrange(40))]
        if turn % 3 == 0:
            text = text[:7] * 5
        expected = sorted(range(len(text)), key=lambda k: text[k:])
        assert suffix_array(np.array(text, int)).tolist() == expected


def expected(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = [True] * length
            seen.add(raw[k : k + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        sha = hashlib.sha256(kept).hexdigest()
        out.append((doc_id, len(raw), len(raw) - len(kept), spans, sha))
    return sorted(out, key=str)


def found(df, length, gram):
    result = repeats.remove_repeats(df, length, gram).select(
        "doc_id",
        "n_bytes",
        F.col("n_bytes") - F.octet_length("kept"),
        F.size("spans"),
        F.sha2("kept", 256),
    )
    return sorted(map(tuple, result.collect()), key=str)


def rows():
    rng = random.Random(2)
    letters = "abcdefghij é\n"
    passage = "".join(rng.choice(letters) for _ in range(90))
    texts = ["", None, "short", "a" * 400, "ab" * 150, passage, passage[:30]]
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(150)))
        begin, stop = sorted(rng.randrange(91) for _ in range(2))
        cut = rng.randrange(len(text) + 1)
        texts.append(text[:cut] + passage[begin:stop] + text[cut:])
        if rng.random() < 0.3:
            copy = list(texts[-1])
            for _ in range(rng.randrange(3)):
                if copy:
                    copy[rng.randrange(len(copy))] = "x"
            texts.append("".join(copy))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [*zip(ids, texts), (None, passage + "tail of it")]


@pytest.mark.parametrize("length,gram", [(12, 5), (33, 9)])
@pytest.mark.parametrize("sorted_regions", [20_000, 2])
def test_equals_dictionary(spark, monkeypatch, length, gram, sorted_regions):
    monkeypatch.setattr(repeats, "SORTED_REGIONS", sorted_regions)
    if sorted_regions == 2:
        monkeypatch.setattr(repeats, "TASK_REGIONS", 10)
        monkeypatch.setattr(repeats, "_SEGMENT", 64)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows()], SCHEMA).repartition(4)
    assert found(df, length, gram) == expected(rows(), length)


def test_repeated_rows_are_one_document(spark):
    row = (1, "some text that is longer than twelve bytes", 1, 2, 3)
    df = spark.createDataFrame([row, row, (2, row[1], None, None, None)], SCHEMA)
    result = found(df, 12, 5)
    assert [r[:4] for r in result] == [(1, 42, 0, 0), (1, 42, 0, 0), (2, 42, 42, 1)]


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA), 12, 5) == []
