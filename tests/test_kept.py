"""What is kept between runs: replies, staged years, sketches; and kinds of failure."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scriptflow.operators import correction, failures, statistics
from scriptflow.plans.etl import report_of_years, stage_years
from scriptflow.sources.workspace import Workspace


def counting(folder, fails=()):
    """A corrector that leaves a file for every call."""

    def correct(prompt):
        import os
        import uuid

        with open(os.path.join(folder, f"{prompt}_{uuid.uuid4().hex}"), "w"):
            pass
        if prompt in fails:
            raise ValueError(prompt)
        return f"```python\n{prompt}!\n```"

    return correct


def asked(folder):
    return sorted(p.name.split("_")[0] for p in folder.iterdir())


def test_each_prompt_is_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = correction.ReplyStore(str(tmp_path / "store"))
    rows = [(k, f"p{k % 7}") for k in range(50)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, prompt string").repartition(4)
    got = {r.id: r.suggestion for r in store.ask(df, counting(str(calls))).collect()}
    assert got == {k: p and f"{p}!" for k, p in rows}
    assert asked(calls) == [f"p{k}" for k in range(7)]
    more = spark.createDataFrame([(1, "p3"), (2, "p9")], "id int, prompt string")
    assert {r.suggestion for r in store.ask(more, counting(str(calls))).collect()} == {"p3!", "p9!"}
    assert asked(calls) == [*(f"p{k}" for k in range(7)), "p9"]


def test_failed_replies_are_asked_again_only_if_told(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = correction.ReplyStore(str(tmp_path / "store"), shares=2)
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    view = lambda *how, **more: sorted(
        (r.prompt, r.suggestion or "") for r in store.ask(df, *how, **more).collect()
    )
    assert view(counting(str(calls), ["b"])) == [("a", "a!"), ("b", "")]
    assert view(counting(str(calls))) == [("a", "a!"), ("b", "")]
    assert asked(calls) == ["a", "b"]
    assert view(counting(str(calls)), retry=True) == [("a", "a!"), ("b", "b!")]
    assert asked(calls) == ["a", "b", "b"]


def test_what_was_answered_before_a_failure_is_kept(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    df = spark.createDataFrame([(f"p{k}",) for k in range(40)], "prompt string")
    first = correction.ReplyStore(str(tmp_path / "store"), shares=4)
    half = df.filter(F.pmod(F.xxhash64(F.sha2(F.col("prompt").cast("binary"), 256)), F.lit(4)) < 2)
    first.ask(half, counting(str(calls)))  # as far as a job came
    n = len(asked(calls))
    assert 0 < n < 40
    first.ask(df, counting(str(calls)))
    assert len(asked(calls)) == 40 == len(set(asked(calls)))


TX = "id_registro int, nome_cliente string, data_transacao date, valor_transacao double"


def test_other_years_stay_and_are_not_read(spark, tmp_path):
    rows = [(k, f"c{k}", f"202{k % 4}-05-0{k % 9 + 1}", float(k)) for k in range(40)]
    raw = spark.createDataFrame(rows, "id_registro int, nome_cliente string, d string, valor_transacao double")
    raw = raw.select("id_registro", "nome_cliente", F.to_date("d").alias("data_transacao"), "valor_transacao")
    with Workspace(spark, str(tmp_path / "w")) as place:
        stage_years(place, raw, "one")
        folder = tmp_path / "w" / "intermediate_data/transactions_filtered.parquet"
        before = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
        stage_years(place, raw.filter("year(data_transacao) = 2022 AND id_registro < 20"), "two")
        after = {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}
        others = {p for p in before if "=2022" not in str(p)}
        assert {p: after[p] for p in others} == {p: before[p] for p in others}
        report = report_of_years(place, 2022)
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(ano_transacao" in plan or "ano_transacao#" in plan.split("PartitionFilters")[1][:80]
        got = {(r.source_system, r.ano_transacao) for r in report.collect()}
        assert got == {("two", 2022)} and report.count() == 5
        assert report_of_years(place, 2020, 2021, 2023).count() == 30
        with pytest.raises(ValueError, match="own target"):
            place.write_partitions(place.read("intermediate_data/transactions_filtered.parquet"),
                                   "intermediate_data/transactions_filtered.parquet", "ano_transacao")


def test_merge_order_does_not_matter_and_errors_are_bounded(spark):
    rng = random.Random(3)
    rows = [(k % 20, rng.randrange(3000), rng.random()) for k in range(30_000)]
    df = spark.createDataFrame(rows, "day int, who int, value double")
    kept = statistics.sketches(df, "day", "who", "value")
    values, n_who = sorted(v for *_, v in rows), len({w for _, w, _ in rows})
    for order in (kept.orderBy("day"), kept.orderBy(F.desc("day")), kept.repartition(7)):
        row = statistics.report(order.withColumn("all", F.lit(1)), "all", quantiles=(0.1, 0.5, 0.99)).first()
        assert row.n == len(rows)
        assert abs(row.distinct_who - n_who) <= 4 * 1.04 / 2 ** (statistics.LG_REGISTERS / 2) * n_who
        for q, value in ((0.1, row.q10), (0.5, row.q50), (0.99, row.q99)):
            rank = sum(v <= value for v in values) / len(values)
            assert abs(rank - q) <= 2 * 1.8 / statistics.ITEMS + 1 / len(values)
    by_day = statistics.report(kept, "day").orderBy("day").collect()
    for r in by_day:  # few values are kept as they are
        own = [(w, v) for d, w, v in rows if d == r.day]
        assert (r.n, r.distinct_who) == (len(own), len({w for w, _ in own}))
        assert r.q50 == sorted(v for _, v in own)[(len(own) + 1) // 2 - 1]


def plain_kinds(errors, depth=2):
    leaves = defaultdict(list)
    mask = lambda w: "<*>" if any(c in "0123456789" for c in w) else w
    for kind, message in errors:
        if kind is not None:
            words = [w for w in (message or "").split(" ") if w]
            leaves[kind, len(words), tuple(map(mask, words[:depth]))].append(words)
    out = defaultdict(int)
    for (kind, *_), messages in leaves.items():
        places = zip(*messages)
        template = " ".join(mask(p[0]) if len(set(p)) == 1 else "<*>" for p in places)
        out[kind, template] += len(messages)
    return sorted((k, t, n) for (k, t), n in out.items())


def test_failure_kinds(spark):
    rng = random.Random(7)
    words = ["column", "a1", "a2", "not", "found", "in", "table", "t", "u", "é"]
    errors = [
        (rng.choice(["KeyError", "ValueError", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(6))))
        for _ in range(400)
    ]
    errors += [("KeyError", None), ("KeyError", ""), ("KeyError", "  column   a1  "), ("E", "x " * 3000)]
    want = plain_kinds(errors)
    for seed in range(2):
        random.Random(seed).shuffle(errors)
        df = spark.createDataFrame(errors, "error_type string, error_message string").repartition(1 + 6 * seed)
        assert sorted(map(tuple, failures.failure_kinds(df).collect())) == want
    empty = spark.createDataFrame([], "error_type string, error_message string")
    assert failures.failure_kinds(empty).collect() == []
