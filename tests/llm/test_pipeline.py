"""The pipeline: each stage against a plain version of its decision."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from scriptflow.llm import decontamination, quality
from scriptflow.sources.storage import stage

from .test_decontamination import brute
from .test_jaccard import expected as similar

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before each stage, and the result."""
    docs = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for name, step in pipeline.STAGES:
        docs.append(stage(step(spark, docs[-1], SF_DIR), name))
    return docs


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_are_kept(steps):
    for docs in steps[1:-1]:
        assert docs.columns == steps[0].columns


def test_classifier(spark, steps):
    scored = quality.op3_quality(spark, SF_DIR).filter("predicted = 1")
    assert ids(steps[1]) == ids(scored)


def test_exact(steps):
    best = {}
    for r in steps[1].collect():
        norm = re.sub(r"[\x20\x09-\x0D]+", "", r.text or "")
        rank = (-len(r.text or ""), r.doc_id)
        best[norm] = min(best.get(norm, rank), rank)
    assert ids(steps[2]) == sorted(k for _, k in best.values())


def test_similar(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    kept = [r[0] for r in similar(rows, (80, 100), 5) if r[0] == r[2]]
    assert ids(steps[3]) == sorted(kept)


def test_benchmark(spark, steps):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").collect()
    edge = ".,;:!?\"'()[]{}"
    items = [[w.strip(edge).lower() for w in r.text.split()] for r in items]
    docs = [(r.doc_id, r.text) for r in steps[3].collect()]
    leaks = brute(items, docs)
    assert ids(steps[4]) == sorted(k for k, _ in docs if k not in leaks)
    assert decontamination.SEGMENT == 13


def test_packed(steps):
    rows = steps[5].collect()
    assert {r.doc_id for r in rows} == set(ids(steps[4]))
    sequences = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert len(pieces) <= pipeline.DOCUMENTS
        assert ends[-1] <= 2048 and [o for o, _ in sorted(pieces)] == [0, *ends[:-1]]
    assert len(sequences) <= sum(r.length for r in rows) / 2048 * 1.05 + 1


def test_packed_documents_are_bounded(spark):
    docs = spark.createDataFrame([(k, "a") for k in range(300)], "doc_id bigint, text string")
    sizes = pipeline.pack(spark, docs, SF_DIR).groupBy("sequence_id").count().collect()
    assert sorted(r["count"] for r in sizes) == [300 - 4 * 64, 64, 64, 64, 64]


def test_odd_rows_pass_all_stages(spark, tmp_path):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame(
        [(-1, None), (-2, ""), (-3, "a"), (-3, "a"), (None, "b c"), (-5, "w " * 200_000)],
        "doc_id bigint, text string",
    )
    extra = {"row": F.lit("x"), "node": F.lit(1), "digest": F.lit(None).cast("string")}
    for rows, name in ((documents.unionByName(odd, True), "odd"), (documents.limit(0), "empty")):
        rows.withColumns(extra).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for table in ("labels", "benchmark"):
            os.symlink(f"{SF_DIR}/{table}.parquet", f"{tmp_path}/{name}/{table}.parquet")
    rows = pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sum(r.doc_id == -3 for r in rows) <= 1
    places = {}
    for r in rows:
        places.setdefault((r.doc_id, r.piece), []).append(r)
    assert all(len(found) == 1 for found in places.values())
    assert pipeline.run(spark, f"{tmp_path}/empty").collect() == []


def test_registered(spark, steps):
    result = entry.queries()["pipeline"](spark, SF_DIR)
    assert result.count() == steps[5].count()


def five_word_sets(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + 5]) for k in range(len(found) - 4)}


def test_similar_by_five_words(spark):
    docs = []
    for length, replaced in ((100, (30, 70)), (200, (20, 70, 120, 170)), (50, (25,)), (60, (15, 30, 45))):
        text = [f"w{length}x{k}" for k in range(length)]
        copy = ["new" if k in replaced else w for k, w in enumerate(text)]
        docs += [(len(docs) + 1, " ".join(text)), (len(docs) + 2, " ".join(copy))]
    docs += [(20, "a b c d"), (21, "A b c d"), (22, "a b c e"), (23, None)]
    sets = {k: five_word_sets(t) for k, t in docs}
    link = lambda a, b: 100 * len(a & b) >= 80 * len(a | b) > 0
    kept = [k for k in sets if not any(j < k and link(sets[j], sets[k]) for j in sets)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert ids(pipeline.join_similar(spark, df, SF_DIR)) == kept == [1, 3, 5, 7, 8, 20, 22, 23]
