"""Conversation repair against a plain dynamic programme over whole rows, and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from scriptflow.llm import turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies_of string, gaps int"
LEGAL = re.compile("(s?(ua)+)?")


def faulty(rows):
    seen, out = set(), []
    for role, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]", text)
        if not found:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if found[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every(rows, faults, inserts=2):
    """All edits of few rows, at most ``inserts`` turns inserted at each place."""
    moves = []
    for (role, text), fault in zip(rows, faults):
        more = 3 if fault == "truncated" else 0
        options = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            options.append((more, "K", [(role, text)]))
            options += [(3 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        moves.append(options)
    fills = [(3 * n, "I" * n, list(zip(f, [""] * n)))
             for n in range(inserts + 1) for f in itertools.product(("user", "assistant"), repeat=n)]
    places = [fills]
    for options in moves:
        places += [options, fills]
    best = None
    for chosen in itertools.product(*places):
        cost = sum(c[0] for c in chosen)
        audit = "".join(c[1] for c in chosen)
        if best and (cost, audit) >= best[:2]:
            continue
        out = [t for c in chosen for t in c[2]]
        if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in out)):
            best = (cost, audit, out)
    return best


def dynamic(rows, faults):
    """The same by whole strings: the best for each place in the grammar."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", [])}

    def put(into, state, value):
        if state is not None and (state not in into or value < into[state]):
            into[state] = value

    def filled():
        out = dict(best)
        for _ in range(3):
            for state, (cost, audit, done) in list(out.items()):
                for role in ("user", "assistant"):
                    to = follow.get((state, role[0]))
                    put(out, to, (cost + 3, audit + "I", done + [(role, "")]))
        return out

    for (role, text), fault in zip(rows, faults):
        new = {}
        more = 3 if fault == "truncated" else 0
        for state, (cost, audit, done) in filled().items():
            put(new, state, (cost + 4, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            put(new, follow.get((state, role[:1])), (cost + more, audit + "K", done + [(role, text)]))
            for given in ("user", "assistant"):
                put(new, follow.get((state, given[0])),
                    (cost + 3 + more, audit + "R", done + [(given, text)]))
        best = new
    return min(v for k, v in filled().items() if k in ("", "a"))


def digest(done):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()


def parsed(rows, faults):
    repair = turns.Repair()
    for (role, text), fault in zip(rows, faults):
        repair.add(role, text, fault)
    return repair.result()


ROLES = ["user", "assistant", "system", "tool", " ", "", "umpire", "User"]
TEXTS = ["Yes.", "Why?", "no end", "", " \t", "Really!  "]


def random_rows(rng, n, roles=ROLES):
    return [(rng.choice(roles), rng.choice(TEXTS) + str(rng.randrange(2)) * rng.randrange(2)) for _ in range(n)]


def test_all_edits_of_few_rows():
    rng = random.Random(1)
    for n in (0, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 3, 3, 3):
        rows = random_rows(rng, n)
        faults = faulty(rows)
        cost, audit, done = every(rows, faults, 2 if n < 3 else 1)
        assert dynamic(rows, faults) == (cost, audit, done)
        assert parsed(rows, faults) == (cost, audit, digest(done))


@pytest.mark.parametrize("roles", [ROLES, ROLES[:3], ["assistant"], ["tool"], ["system", "user"]])
def test_equals_dynamic_programme(roles):
    rng = random.Random(len(roles))
    for _ in range(150):
        rows = random_rows(rng, rng.randrange(25), roles)
        faults = [f if rng.random() < 0.5 else None for f in faulty(rows)]
        cost, audit, done = dynamic(rows, faults)
        assert parsed(rows, faults) == (cost, audit, digest(done))


def test_long_conversations_share_their_audits():
    rows = [("tool", f"{k}.") for k in range(20_000)]
    cost, audit, _ = parsed(rows, [None] * len(rows))
    assert cost == 60_000 and audit == "R" * len(rows)
    repair = turns.Repair()
    for k in range(5000):
        repair.add(("user", "assistant")[k % 2], "x.", None)
    assert len(repair.stacks) <= len(repair.parser.tops) < 20


def test_other_grammar(monkeypatch):
    """Any grammar does: here turns come in pairs of the same role."""
    parser = turns.Parser((("C", ""), ("C", "Cuu"), ("C", "Caa")))
    stacks = set(parser.start)
    for symbol in "uuaa":
        stacks = {to for k in stacks for to in parser.shift(k, symbol)}
    assert any(parser.accepts(k) for k in stacks)
    assert not any(parser.shift(k, "a") for k in parser.shift(parser.start[0], "u"))


def plain(rows):
    """The query, from undamaged rows."""
    conversations = {}
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        copies = {0: 0, 3: 2}.get(kind, 1)
        conversations.setdefault(conv_id, []).extend([(turn, role, text)] * copies)
    out = []
    for conv_id, some in conversations.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        numbers = [t for t, *_ in some if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        said = [r[1:] for r in some]
        faults = faulty(said)
        initials = [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, done = dynamic(said, faults)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv_id, gaps, *counts, illegal, cost, audit, digest(done)))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(3)
    rows = []
    for conv_id in [None, *range(60)]:
        for turn in range(rng.randrange(1, 12)):
            role, text = random_rows(rng, 1)[0]
            turn = rng.choice([turn, turn, turn + 3, None, 0])
            rows.append((conv_id, turn, rng.choice([role, role, None]), rng.choice([text, text, None])))
    rows += rows[:20]
    rows += [(99, k, "tool", "x" * 100_000 + ".") for k in range(5)]
    return rows


def found(df):
    return sorted(map(tuple, turns.repair(turns.damage(df)).select("conv_id", *turns.COLUMNS).collect()), key=str)


def test_odd_rows(spark):
    rows = odd_rows()
    random.Random(7).shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    assert found(df) == plain(rows)


def test_all_rows_dropped(spark):
    dropped = [t for t in range(400) if zlib.crc32(f"5:{t}".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(5, t, "user", "a.", "", 0) for t in dropped], SCHEMA)
    assert found(df) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_small_batches(spark):
    """A conversation may be cut by batches anywhere."""
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(df) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_undamaged_and_empty(spark):
    df = spark.createDataFrame(
        [(1, 0, "system", "s.", "", 0), (1, 1, "user", "u.", "", 0), (1, 2, "assistant", "a.", "", 0)], SCHEMA
    )
    row = turns.repair(df).first()
    assert (row.cost, row.audit, row.illegal) == (0, "KKK", 0)
    assert turns.repair(df.filter("conv_id > 1")).collect() == []
