"""Licence notices and licence expressions in documents.

An Aho-Corasick automaton finds two kinds of places in one pass each:

* **notices**, phrases of words that stand next to each other, in the words of the text;
* **tags** such as ``SPDX-License-Identifier:``, in the text as it is written. What
  follows a tag, as far as it is a licence expression, is read by a shunting-yard parser
  and evaluated: ``with`` binds before ``and``, ``and`` before ``or``.

A licence has a permission from 0 (use is not allowed) to 1 (nearly free). ``a or b``
gives the larger one, since the reader chooses, ``a and b`` the smaller one, and an
exception after ``with`` lifts a licence to ``EXCEPTION`` at least. The permission of a
document is the smallest of its places.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case.

Defined cases: a null or empty text has no words, no labels, a score of 0 and no
permission; an expression that breaks off counts up to its last complete part, one that
names no known licence counts for nothing; overlapping places all count; repeated rows
are scanned one by one; a null id stays null; other columns of the table are not read.
"""

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Further notices: words, label.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license v2": "gpl-2",
    "gnu general public license v3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons zero": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "released into the public domain": "public-domain",
}

#: What an expression may follow, in lower case.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")

#: Permission by the longest beginning of an identifier.
PERMISSION = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "0bsd": 1.0, "isc": 1.0, "zlib": 1.0,
    "unlicense": 1.0, "public-domain": 1.0, "cc0": 1.0, "cc-by": 0.9, "python": 1.0,
    "mpl": 0.6, "lgpl": 0.6, "epl": 0.6, "cddl": 0.6, "artistic": 0.6, "eupl": 0.5,
    "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.1, "cc-by-nc": 0.1,
    "licenseref": 0.0,
}
#: The permission that an exception lifts a licence to.
EXCEPTION = 0.6

#: Doubt that one place of a kind leaves; the score is one less the product.
DOUBT = {"tag": 0.05, "notice": 0.2}

_BINDING = {"or": 1, "and": 2, "with": 3}
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[ \t\"']*(\(|\)|[a-z0-9][a-z0-9.+\-]*)")


def label_of(name: str) -> str | None:
    """The label of a licence identifier in lower case, None if it is not known.

    Versions lose a ``.0``; ``-only``, ``-or-later`` and ``+`` do not count, nor do
    versions of Creative Commons licences.
    """
    name = re.sub(r"(-only|-or-later|\+)$", "", name.rstrip(".-"))
    name = re.sub(r"(\.0)+$", "", name)
    if name.startswith("cc"):
        name = re.sub(r"-[\d.]+$", "", name)
    return name if _family(name) else None


def _family(label: str) -> str | None:
    parts = re.split(r"(?=[-.])", label)
    heads = ("".join(parts[:n]) for n in range(len(parts), 0, -1))
    return next((h for h in heads if h in PERMISSION), None)


def permission(label: str) -> float:
    return PERMISSION[_family(label)]


def expression(text: str, start: int) -> list[str]:
    """The tokens of the longest licence expression that begins at ``start``."""
    tokens, depth, complete, operand = [], 0, 0, True
    for found in iter(lambda: _TOKEN.match(text, start), None):
        token = found[1]
        if operand:
            if token == ")" or token in _BINDING:
                break
            depth += token == "("
            operand = token == "("
        elif token == ")":
            if not depth:
                break
            depth -= 1
        elif token in _BINDING:
            operand = True
        else:
            break
        start = found.end()
        tokens.append(token)
        if not depth and not operand:
            complete = len(tokens)
    return tokens[:complete]


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operators behind their operands."""
    out, held = [], []
    for token in tokens:
        if token == "(":
            held.append(token)
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif token in _BINDING:
            while held and held[-1] != "(" and _BINDING[held[-1]] >= _BINDING[token]:
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    return out + held[::-1]


def evaluate(tokens: list[str]) -> tuple[set[str], float] | None:
    """The licences that an expression names, and its permission.

    An unknown name gives way to the other side of its operator; None if no name is
    known. What stands after ``with`` is an exception and no licence.
    """
    stack: list[tuple[set[str], float] | None] = []
    for token in postfix(tokens):
        if token not in _BINDING:
            label = label_of(token)
            stack.append(({label}, permission(label)) if label else None)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(left and (left[0], max(left[1], EXCEPTION)))
        elif left is None or right is None:
            stack.append(left or right)
        else:
            pick = max if token == "or" else min
            stack.append((left[0] | right[0], pick(left[1], right[1])))
    return stack[0] if stack else None


@functools.cache
def _automata():
    import ahocorasick

    notices, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in BASE.keys() | NOTICES.keys():
        # Between single blanks, so that only whole words are found.
        notices.add_word(f" {phrase} ", phrase)
    for tag in TAGS:
        tags.add_word(tag, tag)
    notices.make_automaton()
    tags.make_automaton()
    return notices, tags


def scan(text: str | None) -> dict:
    """What one text says about its licences."""
    lowered = (text or "").encode().lower()  # of bytes only A-Z change
    words = _WORDS.findall(lowered)
    notices, tags = _automata()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")

    base: list[tuple[int, str]] = []
    labels, least, doubt = set(), [], 1.0
    counted, word = 0, 0  # blanks are counted on from the place before
    places = sorted((end - len(phrase) - 1, phrase) for end, phrase in notices.iter(line))
    for at, phrase in places:
        if phrase in BASE:
            word += line.count(" ", counted, at)
            counted = at
            base.append((word, BASE[phrase]))
        label = BASE.get(phrase) or NOTICES[phrase]
        labels.add(label)
        least.append(permission(label))
        doubt *= DOUBT["notice"]
    raw, expressions, read = lowered.decode("latin-1"), [], 0
    for end, _ in tags.iter(raw):
        if end < read:  # inside the expression before
            continue
        tokens = expression(raw, end + 1)
        value = evaluate(tokens)
        if value:
            labels |= value[0]
            least.append(value[1])
            doubt *= DOUBT["tag"]
            expressions.append(" ".join(tokens))
            read = end
    # A general label goes where a more exact one of the same text says the same.
    exact = {one for one in labels if not any(two.startswith(f"{one}-") for two in labels)}
    base_labels = {label for _, label in base}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": base[0][0] if base else None,
        "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(exact | base_labels)),
        "score": 1.0 - doubt,
        "permission": min(least) if least else None,
        "expressions": expressions,
    }


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("permission", T.DoubleType()),
        T.StructField("expressions", T.ArrayType(T.StringType())),
    ]
)

_ARROW = pa.schema(
    [
        *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")],
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("permission", pa.float64()),
        ("expressions", pa.list_(pa.string())),
    ]
)


def _rows(batches):
    for batch in batches:
        found = pa.RecordBatch.from_pylist([scan(t) for t in batch.column(1).to_pylist()], _ARROW)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *found.columns], ["doc_id", *_ARROW.names]
        )


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the columns of ``RESULT`` for every row, one scan and no shuffle."""
    slim = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    schema = T.StructType([slim.schema["doc_id"], *RESULT.fields])
    return slim.mapInArrow(_rows, schema)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
