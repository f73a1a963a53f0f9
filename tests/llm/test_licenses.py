"""Licence scans against a plain version, and the parser against hand-made values."""

import itertools
import random
import re

import duckdb
import pytest

from scriptflow.llm import licenses

SCHEMA = "doc_id bigint, text string, labels string, score int"
SF_DIR = "/root/testdata/sf0.01"


def plain(text):
    """The base columns, word by word."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = []
    for phrase, label in licenses.BASE.items():
        want = phrase.split()
        places += [
            (k, label) for k in range(len(words)) if words[k : k + len(want)] == want
        ]
    starts = [k for k, _ in places]
    return (
        len(words),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({label for _, label in places})),
    )


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels")


def rows():
    rng = random.Random(5)
    pool = ["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "by", "nc", "é", "x"]
    texts = [
        " ".join(rng.choice(pool) for _ in range(rng.randrange(60))).replace("é ", "é-") for _ in range(300)
    ]
    texts += [
        None,
        "",
        " \t\n",
        "Released under the MIT License.",
        "cc by nc by nc cc-by-nc CC BY\nNC",
        "under the mit license under the mit license",
        "İunder the mit license",
        "x" * 300_000 + " cc by nc " + "y " * 200_000 + "Apache License, Version 2.0",
    ]
    return [(k, t, "clash", 1) for k, t in enumerate(texts)] + [
        (None, "cc by nc", None, None),
        (3, texts[3], "clash", 1),
    ]


def test_base_equals_plain(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = licenses.scan_documents(df).select("doc_id", *COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(k, *plain(t)) for k, t, *_ in rows()], key=str
    )


@pytest.mark.parametrize(
    "text, labels, permission",
    [
        ("SPDX-License-Identifier: MIT", "mit", 1.0),
        ("# SPDX-License-Identifier: Apache-2.0 OR GPL-3.0-only\nx", "apache-2,gpl-3", 1.0),
        ("License: mit and gpl-2.0-or-later", "gpl-2,mit", 0.3),
        ("license: GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2", 0.6),
        ("license: mit or gpl-3.0 and agpl-3.0", "agpl-3,gpl-3,mit", 1.0),
        ("license: (mit or gpl-3.0) and agpl-3.0", "agpl-3,gpl-3,mit", 0.2),
        ("license: ((mit))) and gpl-3.0", "mit", 1.0),
        ("license: (mit or", "", None),
        ("license: mit or", "mit", 1.0),
        ("license: and mit", "", None),
        ("license: needed to drive", "", None),
        ("license: whatever or cc-by-nc-4.0", "cc-by-nc", 0.1),
        ("license: CC-BY-SA-4.0 license: LicenseRef-own", "cc-by-sa,licenseref-own", 0.0),
        ("Licensed under the Apache License, Version 2.0.", "apache-2", 1.0),
        ("the GNU General Public License, version 3", "gpl-3", 0.3),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc", 0.1),
        ("mitigate the bmit license", "", None),
    ],
)
def test_labels(text, labels, permission):
    found = licenses.scan(text)
    assert (found["labels"], found["permission"]) == (labels, permission)
    assert (found["score"] > 0) == bool(labels) and 0 <= found["score"] <= 1


def test_expressions_equal_python():
    """Operators as Python's own, whose ``and`` also binds before ``or``."""
    rng = random.Random(2)
    names = {"mit": 1.0, "mpl-2.0": 0.6, "gpl-3.0": 0.3, "agpl-3.0": 0.2, "cc-by-nc-4.0": 0.1}

    class Value(float):
        def __and__(self, other):
            return Value(min(self, other))

        def __or__(self, other):
            return Value(max(self, other))

    def build(depth):
        if not depth or rng.random() < 0.3:
            name = rng.choice(list(names))
            return [name], f"Value({names[name]})"
        parts = [build(depth - 1) for _ in range(rng.randrange(1, 4))]
        words, code = list(parts[0][0]), parts[0][1]
        for more, text in parts[1:]:
            op, sign = rng.choice([("and", "&"), ("or", "|")])
            words += [op, *more]
            code += f" {sign} {text}"
        return ["(", *words, ")"], f"({code})"

    for depth in itertools.islice(itertools.cycle(range(5)), 300):
        words, code = build(depth)
        text = " ".join(words)
        assert licenses.expression(text, 0) == words
        assert licenses.evaluate(words)[1] == eval(code, {"Value": Value})


def test_deep_and_long_expressions():
    n = 20_000
    assert licenses.scan("license: " + "(" * n + "mit" + ")" * n)["labels"] == "mit"
    assert licenses.scan("license: " + " or ".join(["gpl-3.0"] * n))["permission"] == 0.3


def test_base_keeps_general_labels():
    assert licenses.scan("under the mit license. license: mit-0")["labels"] == "mit,mit-0"


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert licenses.scan_documents(empty).collect() == []


def test_whole_table(spark):
    got = licenses.op13_licenses(spark, SF_DIR).collect()
    docs = duckdb.execute(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    want = sorted((k, *plain(t)) for k, t in docs)
    assert sorted((r.doc_id, *[r[c] for c in COLUMNS]) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
