"""Line diffs: applied they give the new text, and none is shorter."""

import itertools
import random

import pytest

from scriptflow.functions import linediff
from scriptflow.operators import attempts


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def check(old, new, max_edits=linediff.MAX_EDITS):
    found, minimal = linediff.hunks(old, new, max_edits)
    assert linediff.applied(old, found) == new
    a, b = old.split("\n"), new.split("\n")
    edits = sum(removed + len(added) for _, removed, added in found)
    least = len(a) + len(b) - 2 * longest_common(a, b)
    assert edits >= least and (edits == least or not minimal)
    for (at, removed, added), (after, *_) in zip(found, found[1:]):
        assert at + removed < after  # runs are as long as they can be
    assert all(removed or added for _, removed, added in found)
    return found


def test_all_short_texts():
    texts = ["\n".join(t) for n in range(1, 5) for t in itertools.product("ab", repeat=n)]
    for old, new in itertools.product([*texts, "", "\n"], repeat=2):
        check(old, new)


@pytest.mark.parametrize("max_edits", [1000, 5, 0])
def test_random_texts(max_edits):
    rng = random.Random(max_edits)
    for _ in range(300):
        old = [rng.choice("abcde") for _ in range(rng.randrange(1, 30))]
        new = list(old)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(new) + 1)
            new[at : at + rng.randrange(3)] = [rng.choice("abcde") for _ in range(rng.randrange(3))]
        check("\n".join(old), "\n".join(new or [""]), max_edits)


def test_long_scripts_take_bounded_work():
    old = "\n".join(f"a{k}" for k in range(50_000))
    new = "\n".join(f"b{k}" for k in range(50_000))
    found, minimal = linediff.hunks(old, new, 50)
    assert not minimal and len(found) == 1 and linediff.applied(old, found) == new
    some = old.replace("a7\n", "").replace("a40000", "z")
    found, minimal = linediff.hunks(old, some)
    assert minimal and [h[:2] for h in found] == [(7, 1), (40000, 1)]


def test_operator(spark):
    rows = [(1, 1, "a\nb", "a\nc"), (2, 1, "x", "x"), (3, 1, "x", None), (4, 2, None, "s\nt"), (5, 1, "a", "")]
    df = spark.createDataFrame(rows, "run_id long, attempt int, code string, suggestion string")
    got = sorted(map(tuple, attempts.suggestion_diff(df).collect()))
    assert got == [
        (1, 1, 1, 1, 1, 1, "c", True),
        (4, 2, 1, 0, 1, 2, "s\nt", True),
        (5, 1, 1, 0, 1, 1, "", True),
    ]
