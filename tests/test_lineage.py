"""The order of scripts against a plain search over all pairs."""

import random

import pytest

from scriptflow.operators import lineage


def plain(n, uses):
    reads = {k: {p for s, p, d in uses if s == k and d == "read"} for k in range(n)}
    writers = {}
    for s, p, d in uses:
        if d == "write":
            writers.setdefault(p, set()).add(s)
    needs = {k: {w for p in reads[k] for w in writers.get(p, ())} - {k} for k in range(n)}

    def reached(k):
        seen, todo = set(), list(needs[k])
        while todo:
            one = todo.pop()
            if one not in seen:
                seen.add(one)
                todo += needs[one]
        return seen

    reach = {k: reached(k) for k in range(n)}
    cycles = {k for k in range(n) if k in reach[k]}
    stuck = cycles | {k for k in range(n) if reach[k] & cycles}
    # Between two cycles: waits for one, and one waits for it.
    core = {k for k in stuck if k in cycles or any(k in reach[c] for c in cycles)}

    def level(k):
        return max((level(w) + 1 for w in needs[k]), default=0)

    return [
        (k, None if k in stuck else level(k), k in core, len({p for p in reads[k] if p not in writers}))
        for k in range(n)
    ]


def found(spark, n, uses):
    scripts = spark.createDataFrame([(k,) for k in range(n)], "script_id long")
    calls = spark.createDataFrame(uses, "script_id long, path string, direction string")
    return sorted(map(tuple, lineage.script_order(scripts, calls).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 25
    uses = [
        (rng.randrange(n), f"p{rng.randrange(20)}", rng.choice(["read", "write", "read"]))
        for _ in range((20, 35, 60)[seed])
    ]
    assert found(spark, n, uses) == plain(n, uses)


def test_odd_rows(spark):
    uses = [
        (0, "x", "write"), (0, "x", "read"), (1, "x", "read"), (1, "x", "read"),
        (2, None, "read"), (2, "y", "unknown"), (3, "z", "read"), (None, "x", "read"),
    ]
    assert found(spark, 4, uses) == [(0, 0, False, 0), (1, 1, False, 0), (2, 0, False, 0), (3, 0, False, 1)]
    assert found(spark, 2, [(0, "x", "unknown")]) == [(0, 0, False, 0), (1, 0, False, 0)]


def test_rounds_are_bounded_by_depth_and_hubs_stay_linear(spark, monkeypatch):
    sizes = []
    real = lineage.stage
    monkeypatch.setattr(lineage, "stage", lambda df, label: sizes.append(real(df, label)) or sizes[-1])
    n = 300
    uses = [(k, "hub", "write" if k < n // 2 else "read") for k in range(n)]
    got = found(spark, n, uses)
    assert got == [(k, int(k >= n // 2), False, 0) for k in range(n)]
    assert len(sizes) <= 4 and max(s.count() for s in sizes) <= n
