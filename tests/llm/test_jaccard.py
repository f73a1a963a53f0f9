"""The similarity join against all pairs."""

import random
import re

import pytest

from scriptflow.llm import graphs, jaccard

SCHEMA = "doc_id bigint, text string, node string, family int, grams int, signature int"
THRESHOLD = (90, 100)


def shingles(text, n=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


def expected(rows, threshold=THRESHOLD, n=3):
    num, den = threshold
    sets = [shingles(r[1], n) for r in rows]
    links = [set() for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                links[i].add(j)
                links[j].add(i)
    component = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            least = min([component[i], *(component[j] for j in near)])
            if least != component[i]:
                component[i], changed = least, True
    least = {}
    for i, c in enumerate(component):
        ids = [x for x in (least.get(c), rows[i][0]) if x is not None]
        least[c] = min(ids) if ids else None
    return sorted(
        [(r[0], len(s), least[c], len(n)) for r, s, c, n in zip(rows, sets, component, links)],
        key=str,
    )


def variants(seed, n, length, edits):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(400)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(length)] = f"v{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            own = own[: rng.randrange(length * 4 // 5, length)]
        out.append(" ".join(own))
    return out


def rows():
    texts = [
        *variants(1, 40, 120, 6),
        *variants(2, 25, 14, 1),
        *variants(3, 15, 1500, 40),
        *[" ".join(f"x{k}" for k in range(n)) for n in range(1, 13)],  # 9 and 10 shingles link
        *["", None, " \t", "One TWO three", "one two Three", "one", "ONE", "a b c"],
        *["same text as the next one of all"] * 30,
    ]
    out = [(k * 7 % 1009, t, "x", 1, 2, 3) for k, t in enumerate(texts)]
    return out + [(None, "one two three", None, None, None, None), out[0], out[50]]


def found(df, *how):
    columns = ("doc_id", "n_shingles", "component_id", "n_links")
    return sorted(map(tuple, jaccard.similar(df, *how).select(*columns).collect()), key=str)


HOW = [((90, 100), 3), ((80, 100), 5), ((50, 100), 2), ((100, 100), 3)]


@pytest.mark.parametrize("how", HOW)
@pytest.mark.parametrize("blocks", ["large", "small"])
def test_equals_all_pairs(spark, monkeypatch, blocks, how):
    if blocks == "small":  # families are cut into many blocks and slabs, joins shuffle
        monkeypatch.setattr(jaccard, "BLOCK_NODES", 4)
        monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 2000)
        monkeypatch.setattr(jaccard, "BUNDLE_GRAMS", 500)
        monkeypatch.setattr(jaccard, "GROUP_NODES", 5)
        monkeypatch.setattr(jaccard, "SMALL_GROUP", 3)
        monkeypatch.setattr(graphs, "BROADCAST_BYTES", -1)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    assert found(df, *how) == expected(rows(), *how)


@pytest.mark.parametrize("how", HOW)
def test_sparse_product(how, monkeypatch):
    threshold, n = how
    sets = [s for s in jaccard._sets(jaccard.pa.array([r[1] for r in rows()]), n) if len(s)]
    num, den = threshold
    for side in (None, jaccard.np.arange(len(sets)) % 2):
        linked = jaccard._links(sets, side, threshold)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                same = len(jaccard.np.intersect1d(a, b))
                want = i != j and den * same >= num * (len(a) + len(b) - same)
                assert linked[i, j] == (want and (side is None or side[i] != side[j]))


def random_sets(rng, threshold):
    """Pairs of sets that differ as much as linked ones can."""
    num, den = threshold
    for size in [*range(1, 60), 75, 100, 128, 150, 200, 256, 300, 511, 600, 1024, 1900]:
        universe = rng.integers(0, 2**64, 3 * size + 3, dtype=jaccard.np.uint64)
        a = universe[:size]
        for smaller in {size, max(1, -(-size * num // den))}:
            same = -(-num * (size + smaller) // (num + den))
            yield jaccard.np.unique(a), jaccard.np.unique([*a[:same], *universe[size : size + smaller - same]])


@pytest.mark.parametrize("threshold", [(90, 100), (80, 100), (50, 100)])
def test_linked_sets_share_a_signature_and_pass_by_sketch(threshold):
    rng = jaccard.np.random.default_rng(3)
    for _ in range(20):
        for a, b in random_sets(rng, threshold):
            if a.tolist() == b.tolist():
                continue
            shared = jaccard.np.intersect1d(
                jaccard.signatures(a, threshold), jaccard.signatures(b, threshold)
            )
            assert len(shared), (len(a), len(b))
            table = jaccard.pa.table(
                {
                    "family": [0, 0],
                    "node": [1, 2],
                    "n_shingles": [len(a), len(b)],
                    "sketch": [jaccard.sketch(a), jaccard.sketch(b)],
                }
            )
            assert jaccard._near(threshold)(table).num_rows == 1


@pytest.mark.parametrize("threshold", [(90, 100), (80, 100)])
def test_disjoint_sets_meet_nowhere(threshold):
    rng = jaccard.np.random.default_rng(4)
    for size in (2, 5, 10, 38, 70, 150, 256, 600, 1024, 1500, 1900):
        seen = set()
        for _ in range(60):
            own = jaccard.signatures(jaccard.np.unique(rng.integers(0, 2**64, size, dtype="uint64")), threshold)
            assert not seen & set(own.tolist())
            seen |= set(own.tolist())


def test_joined():
    rng = random.Random(8)
    for n in range(1, 40):
        nodes = jaccard.np.array(rng.sample(range(1000), n))
        linked = jaccard.np.zeros((n, n), bool)
        label = nodes.tolist()
        for _ in range(rng.randrange(2 * n)):
            i, j = rng.randrange(n), rng.randrange(n)
            linked[i, j] = linked[j, i] = i != j
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
        assert jaccard._joined(linked, nodes).tolist() == label


def test_shared_passage_makes_no_family(spark, monkeypatch):
    """Documents with a passage of a third of their words in common are no candidates."""
    counted = []
    real = jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda e: counted.append(e.filter("a <> b").distinct().count()) or real(e))
    passage = " ".join(f"p{k}" for k in range(100))
    texts = [(k, passage + " " + " ".join(f"d{k}w{j}" for j in range(200)), "", 0, 0, 0) for k in range(80)]
    texts.append((99, texts[5][1] + " more", "", 0, 0, 0))
    got = found(spark.createDataFrame(texts, SCHEMA), (80, 100), 5)
    assert counted == [1, 1]
    assert [r for r in got if r[2] != r[0]] == [(99, 297, 5, 1)]


def test_groups_of_the_same_nodes_are_one(spark):
    signatures = [(1, [5, 6, 7, 9]), (1, [5, 6, 7, 9]), (2, [5, 6, 7, 8]), (3, [8, 9]), (4, [4])]
    df = spark.createDataFrame(signatures, "node long, signatures array<long>")
    members = {}
    for family, node, n in jaccard._groups(df).collect():
        members.setdefault((family, n), []).append(node)
    assert sorted((sorted(m), n) for (_, n), m in members.items()) == [
        ([1, 2], 3), ([1, 3], 3), ([2, 3], 2)
    ]


def test_very_long_text(spark):
    words = [f"w{k * 7919 % 30011}" for k in range(60_000)]
    near = [w if k % 200 else "new" for k, w in enumerate(words)]
    texts = [(1, " ".join(words), "", 0, 0, 0), (2, " ".join(near), "", 0, 0, 0), (3, "short", "", 0, 0, 0)]
    assert found(spark.createDataFrame(texts, SCHEMA)) == expected(texts)


def test_keep_one(spark):
    kept = jaccard.keep_one(spark.createDataFrame(rows(), SCHEMA))
    assert kept.columns[:3] == ["doc_id", "text", "node"]
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r[0] for r in expected(rows()) if r[0] == r[2]}


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(50)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)] + [(7, 7)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()
    names = {r.node: r.component for r in got}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert names.keys() == linked
    pairs = {(label[n], names[n]) for n in linked}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
