"""Lines that many sites share against sets."""

import pytest
from pyspark.sql import functions as F

from scriptflow.llm import lines

SCHEMA = "doc_id bigint, text string, source string, site int, shared int, line_a int"


def rows():
    out = []
    for k in range(40):
        own = [f"line {k % n}" for n in (3, 5, 8, 40)]
        text = "\n".join([*own, " \tfooter\r", "", f"pair {k // 2}", "footer"])
        out.append((k, text, f"s{k % 9}", 1, 2, 3))
    out += [(100, None, "s1", 1, 2, 3), (101, "", "s1", 1, 2, 3), (102, "footer", None, 1, 2, 3)]
    out += [(103, "only here\n" * 1000, "s1", 1, 2, 3), (104, "\n\n", None, None, None, None)]
    return out + [(None, "line 0\nx", "s3", 1, 2, 3), out[0]]


def expected(sites):
    where = {}
    for _, text, source, *_ in rows():
        for line in (text or "").split("\n"):
            where.setdefault(line.strip(" \t\r"), set()).add(source)
    shared = {line for line, s in where.items() if line and len(s) >= sites}
    out = []
    for doc_id, text, *_ in rows():
        if text is None:
            out.append((doc_id, None, 0, 0))
            continue
        all_ = text.split("\n")
        kept = [x for x in all_ if x.strip(" \t\r") not in shared]
        out.append((doc_id, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out, key=str)


def test_equals_sets(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    for sites in (2, 3, 5, 9, 11):
        got = lines.remove_shared_lines(df, sites)
        got = got.select("document.doc_id", "kept_text", "n_lines", "n_removed").collect()
        assert sorted(map(tuple, got), key=str) == expected(sites)


@pytest.mark.parametrize("sites", [2, 5, 9, 40, 200])
def test_fewer_sites_stay_below_the_bound(spark, sites):
    deviation, bound = lines.sketch_bound(sites)
    groups = spark.range(3000 if sites < 100 else 300).select(
        "id", F.explode(F.sequence(F.lit(1), F.lit(sites - 1))).alias("k")
    )
    about = F.approx_count_distinct(F.xxhash64("id", "k"), deviation).alias("about")
    assert groups.groupBy("id").agg(about).agg(F.max("about")).first()[0] <= bound
    many = spark.range(4 * sites).agg(F.approx_count_distinct(F.xxhash64("id"), deviation))
    assert many.first()[0] > bound


def test_sketches_decide_most_boilerplate(spark, monkeypatch):
    """Over whole tables: what sketches decide is there, and is right."""
    staged = {}
    real = lines.stage
    monkeypatch.setattr(lines, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shared = {tuple(r) for r in lines.shared_lines(docs).collect()}
    _, bound = lines.sketch_bound(lines.SITES)
    decided = staged["line_sketches"].filter(F.col("about") > bound).collect()
    decided = {(r.line_a, r.line_b) for r in decided}
    assert decided and decided <= shared
    sites = lines._occurrences(docs).groupBy("line_a", "line_b").agg(F.count_distinct("site").alias("n"))
    sites = sites.filter(F.col("n") >= lines.SITES).collect()
    assert shared == {(r.line_a, r.line_b) for r in sites}
    assert len(decided) > len(shared) / 2


def test_very_many_sites(spark):
    rows = [(k, "everywhere\nhere", f"site {k}") for k in range(3000)] + [(9999, "here", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = lines.remove_shared_lines(df, 3001).filter("n_removed > 0")
    assert got.count() == 3001 and got.agg(F.max("kept_text")).first()[0] == "everywhere"


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lines.remove_shared_lines(df).collect() == []
