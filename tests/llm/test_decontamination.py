"""Benchmark passages: seeds, alignment, odd inputs."""

import itertools
import random

import pytest

from scriptflow.llm import decontamination as dc

SCHEMA = "doc_id bigint, text string, hits string, document string, item_id int"


def test_masks_find_two_replaced_words():
    for gone in itertools.combinations(range(dc.SEGMENT), 2):
        assert any(
            all(at + k not in gone for k, bit in enumerate(mask) if bit == "1")
            for mask in dc.MASKS
            for at in range(dc.SEGMENT - len(mask) + 1)
        )


def case():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [[word() for _ in range(rng.randrange(16, 60))] for _ in range(30)]
    items += [["one", "two", "three", "four", "five", "six"], ["too", "short"]]
    docs, leaks = [], {}
    for k in range(150):
        text = [word() for _ in range(rng.randrange(120))]
        if k % 3 == 0:
            i = rng.randrange(31)
            part = list(items[i])
            if len(part) > 13:
                begin = rng.randrange(len(part) - 12)
                part = part[begin : begin + rng.randrange(15, 40)]
                for _ in range(rng.randrange(3) if len(part) >= 15 else 0):
                    part[rng.randrange(len(part))] = "replaced"
            equal = sum(p in items[i] for p in part)
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
            # Two replaced words at an end may cut the segment short.
            if len(part) == 6 or equal >= dc.SEGMENT + 2:
                leaks[k] = i
        elif k % 3 == 1:
            part = items[rng.randrange(30)][:9]  # fewer words than a segment
            text[5:5] = part
        docs.append((k, " ".join(w.upper() + rng.choice(["", ",", "."]) for w in text)))
    return items, docs, leaks


def brute(items, docs):
    """Every alignment of every item with every document."""
    out = {}
    for doc_id, text in docs:
        words = [w.strip(",.").lower() for w in text.split()]
        for i, item in enumerate(items):
            if len(item) < dc.LEAST_WORDS:
                continue
            for shift in range(1 - len(item), len(words)):
                low, high = max(0, -shift), min(len(item), len(words) - shift)
                equal = [words[shift + k] == item[k] for k in range(low, high)]
                if sum(equal) >= 5 and dc.verified(dc.np.array(equal), len(item)):
                    out.setdefault(doc_id, set()).add(i)
    return out


@pytest.mark.parametrize("block_words", [500_000, 300])
def test_equals_all_alignments(spark, monkeypatch, block_words):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block_words)
    items, docs, leaks = case()
    benchmark = [(i, " ".join(item)) for i, item in enumerate(items)] + [(98, None), (99, "")]
    benchmark = spark.createDataFrame(benchmark, "item_id bigint, text string").repartition(3)
    df = spark.createDataFrame([(*d, "a", "b", 1) for d in docs], SCHEMA)
    rows = dc.report(dc.find(df, benchmark)).collect()
    got = {r.doc_id: set(r.item_ids) for r in rows if r.contaminated}
    assert got == brute(items, docs)
    assert all(i in got.get(k, ()) for k, i in leaks.items())
    clean = dc.keep_clean(df, benchmark)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {d[0] for d in docs} - got.keys()


def test_odd_inputs(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    rows = [(1, None), (2, ""), (3, "... !!"), (4, text), (4, text), (None, text), (5, "z " * 50_000)]
    df = spark.createDataFrame([(*r, "a", None, 1) for r in rows], SCHEMA)
    items = spark.createDataFrame([(7, text), (7, text), (None, text)], "item_id bigint, text string")
    got = dc.report(dc.find(df, items)).collect()
    assert sorted((str(r.doc_id), r.contaminated) for r in got) == [
        ("1", False), ("2", False), ("3", False), ("4", True), ("4", True), ("5", False), ("None", True)
    ]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.keep_clean(df, none).count() == len(rows)
    assert dc.keep_clean(df.limit(0), items).count() == 0


def counts(equal, item_words):
    """The rule, over all windows."""
    need = max(5, min(13, -(-4 * item_words // 5)))
    windows = (equal[i:j] for i in range(len(equal)) for j in range(i + need, len(equal) + 1))
    return max((sum(w) for w in windows if 5 * sum(w) >= 4 * len(w) and sum(w) >= need), default=0)


@pytest.mark.parametrize("n", [6, 7, 8, 9, 10, 12, 15, 16, 20])
def test_replaced_words_at_every_position(n):
    item = [f"w{k}" for k in range(n)]
    index = dc.Index([1], [" ".join(item)])
    docs, most = [], []
    for k in range(1, 4):
        for gone in itertools.combinations(range(n), k):
            text = ["new" if at in gone else w for at, w in enumerate(item)]
            docs.append(" ".join(["before", *text, "after"]))
            most.append(counts([at not in gone for at in range(n)], n))
    for _, _, data, offsets in dc.words.blocks(dc.pa.array(docs)):
        hits = index.search(data, offsets)
        assert [max((h[3] for h in found), default=0) for found in hits] == most
    assert any(most)
