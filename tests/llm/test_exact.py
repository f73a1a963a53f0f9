"""Exact deduplication against a dictionary of normalised texts."""

import hashlib
import re

import pytest

from scriptflow.llm import exact

SCHEMA = "doc_id bigint, text string, kept string, digest string, document int"
LONG = "abc " * 20_000
ROWS = [
    (5, "a b", "x", "y", 1),
    (3, "ab", "x", "y", 1),
    (4, "a\t b", None, None, None),
    (1, "other", "x", "y", 1),
    (2, None, "x", "y", 1),
    (7, "", "x", "y", 1),
    (8, " \n", "x", "y", 1),
    (9, LONG, "x", "y", 1),
    (10, LONG.strip(), "x", "y", 1),
    (11, "other", "x", "y", 1),
    (11, "other", "x", "y", 1),
    (None, "no id", "x", "y", 1),
    (13, "twice", "x", "y", 1),
    (13, "twice", "x", "y", 1),
    (14, "twi ce ", "x", "y", 1),
    (14, "twi ce ", "x", "y", 1),
    (15, "tw ice ", "x", "y", 1),
    (12, "a b", "x", "y", 1),
]


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", row[1] or ""), []).append(row)
    out = []
    for norm, members in groups.items():
        rank = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
        members = [list(r) for r in members]  # repeated rows are rows of their own
        best = min(members, key=rank)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(r[0], best[0], len(members), r is best, sha) for r in members]
    return sorted(out, key=str)


def found(df):
    rows = df.select("document.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    return sorted(map(tuple, rows), key=str)


# With one byte of digest or none, different texts collide.
@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_equals_dictionary(spark, tmp_path, digest_bytes):
    path = str(tmp_path / "docs")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    assert found(exact.deduplicate(spark, path, digest_bytes)) == expected(ROWS)


def test_state_outlives_batches_and_runs(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    for part in (ROWS[:6], ROWS[6:]):
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(path)
        result = found(exact.deduplicate(spark, path, files_per_batch=1, state=state))
    assert result == expected(ROWS)


def test_keep_first_keeps_columns(spark):
    kept = exact.keep_first(spark.createDataFrame(ROWS, SCHEMA))
    assert kept.columns == ["doc_id", "text", "kept", "digest", "document"]
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([r[0] for r in expected(ROWS) if r[3]], key=str)


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "ab"), (3, "c")]
    kept = exact.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_documents_in_a_folder_are_not_copied(spark, tmp_path, monkeypatch):
    made = []
    real = exact.fresh_dir
    monkeypatch.setattr(exact, "fresh_dir", lambda s, label: made.append(label) or real(s, label))
    path = str(tmp_path / "docs")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    whole = sorted((r.doc_id for r in exact.keep_first(docs).collect()), key=str)
    assert whole == sorted([r[0] for r in expected(ROWS) if r[3]], key=str)
    assert made == ["exact_state"]
    part = docs.filter("doc_id > 2")
    some = [r for r in ROWS if r[0] is not None and r[0] > 2]
    ids = sorted(r.doc_id for r in exact.keep_first(part).collect())
    assert ids == sorted(r[0] for r in expected(some) if r[3])
    few = exact.keep_first(docs.select("doc_id", "text"))
    assert few.columns == ["doc_id", "text"] and few.count() == len(whole)
    assert made.count("exact_input") == 2


def test_empty_table(spark):
    assert exact.keep_first(spark.createDataFrame([], SCHEMA)).collect() == []
