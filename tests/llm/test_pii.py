"""Pseudonyms against a plain Feistel network."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from scriptflow.llm import pii

KEY = "test key"
SCHEMA = "doc_id bigint, text string, found int, document int, safe_text int"


def mixed(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def feistel(kind, a, b, m, n, back=False):
    for k in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        sign = -1 if back else 1
        if k % 2 == 0:
            a = (a + sign * (mixed(KEY, kind, m, n, k, b) % m)) % m
        else:
            b = (b + sign * (mixed(KEY, kind, m, n, k, a) % n)) % n
    return a, b


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total


def halves(kind, digits):
    h = len(digits) // 2
    a, b = feistel(kind, int(digits[:h]), int(digits[h:]), 10**h, 10 ** (len(digits) - h))
    return f"{a:0{h}d}{b:0{len(digits) - h}d}"


def refilled(match, new):
    old = re.sub(r"\D", "", match)
    new = iter(old[: len(old) - len(new)] + new)
    return re.sub(r"\d", lambda _: next(new), match)


def card(match):
    body = halves("card", re.sub(r"\D", "", match)[:-1])
    return refilled(match, body + str(-luhn(body + "0") % 10))


def ip(match):
    w, x, y, z = map(int, match.split("."))
    a, b = feistel("ip", w * 256 + x, y * 256 + z, 1 << 16, 1 << 16)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def date(match):
    form = "%Y-%m-%d" if match[4] == "-" else "%d/%m/%Y"
    day0 = datetime.date(1901, 1, 1)
    cycle, day = divmod((datetime.datetime.strptime(match, form).date() - day0).days, 10227)
    a, b = feistel("date", day // 487, day % 487, 21, 487)
    return (day0 + datetime.timedelta(cycle * 10227 + a * 487 + b)).strftime(form)


def ssn(match):
    area, group, serial = map(int, match.split("-"))
    rank = (area - 1 - (area > 666)) * 99 + group - 1
    a, b = feistel("ssn", rank, serial - 1, 88902, 9999)
    area = a // 99 + 1
    return f"{area + (area >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def phone(match):
    return refilled(match, halves("phone", re.sub(r"\D", "", match)[-10:]))


CASES = [
    ("4111 1111 1111 1111", "card", card),
    ("378282246310005", "card", card),
    ("1234567890123456", "number", lambda m: refilled(m, halves("number", m))),
    ("+1 (337) 555-7349", "phone", phone),
    ("337-555-7349", "phone", phone),
    ("10.0.255.1", "ip", ip),
    ("2024-02-29", "date", date),
    ("31/12/1999", "date", date),
    ("1901-01-01", "date", date),
    ("123-45-6789", "ssn", ssn),
    ("899-99-9999", "ssn", ssn),
]
INVALID = ["300.1.1.1", "2023-02-29", "31/02/2020", "666-12-3456", "123-00-4567", "12345", "1.2.3.4.5"]


def safe(spark, texts):
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in enumerate(texts)], SCHEMA)
    return pii.pseudonymize(df.repartition(2), KEY).orderBy("document.doc_id").collect()


def test_equals_plain_feistel(spark):
    texts = [f"before {v}, after" for v, _, _ in CASES] + [f"<{v}>" for v in INVALID]
    rows = safe(spark, texts)
    for (value, kind, make), row in zip(CASES, rows):
        assert [tuple(f) for f in row.found] == [(kind, value, make(value))]
        assert row.safe_text == f"before {make(value)}, after"
        assert make(value) != value
    for row, text in zip(rows[len(CASES) :], texts[len(CASES) :]):
        assert row.safe_text == text and row.found == []


def test_rounds_can_be_undone():
    for kind, m, n in (("date", 21, 487), ("ssn", 88902, 9999), ("card", 10**7, 10**8)):
        for a, b in ((0, 0), (m - 1, n - 1), (m // 2, 3)):
            assert feistel(kind, *feistel(kind, a, b, m, n), m, n, back=True) == (a, b)


def test_a_permutation_of_a_whole_domain(spark):
    pairs = spark.range(21 * 487).select(F.floor(F.col("id") / 487).alias("a"), (F.col("id") % 487).alias("b"))
    new = pii.feistel(KEY, "date", F.col("a"), F.col("b"), F.lit(21), F.lit(487))
    rows = pairs.select("a", "b", new.alias("n")).collect()
    assert len({(r.n.a, r.n.b) for r in rows}) == 21 * 487
    assert all(feistel("date", r.a, r.b, 21, 487) == (r.n.a, r.n.b) for r in rows[::97])


def test_formats_and_validity_are_kept(spark):
    cards = [f"{k:015d}" for k in range(4000_0000_0000_000, 4000_0000_0000_200)]
    cards = [c + str(-luhn(c + "0") % 10) for c in cards]
    rows = safe(spark, [" ".join(cards)])
    new = rows[0].safe_text.split(" ")
    assert len(set(new)) == len(cards) and all(luhn(c) % 10 == 0 and len(c) == 16 for c in new)


def test_names_and_secrets(spark):
    secret = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    text = f'mail Jo.Doe-7@mail3.example.com, token = "{secret}" {secret.upper()}'
    first, second = (r.safe_text for r in safe(spark, [text, "again " + text]))
    assert second == "again " + first
    assert "@mail3.example.com" in first and "Jo.Doe" not in first
    assert secret not in first and secret.upper() not in first
    shape = lambda t: re.sub("[a-z]", "x", re.sub("[A-Z]", "X", re.sub("[0-9]", "0", t)))
    assert shape(first) == shape(text)
    assert set(re.search('"(.*)"', first)[1]) <= set("0123456789abcdef")


def test_odd_inputs(spark):
    texts = [None, "", "no data", "x" * 300_000, "1.2.3.4" * 3, "10.0.0.1 10.0.0.1\n10.0.0.1", "a@b", "4" * 40]
    rows = safe(spark, texts)
    assert [r.safe_text for r in rows[:4]] == texts[:4]
    assert rows[5].safe_text == f"{ip('10.0.0.1')} {ip('10.0.0.1')}\n{ip('10.0.0.1')}"
    assert rows[0].found == []
    assert safe(spark, []) == []


@pytest.mark.parametrize("digits,total", [("79927398713", 70), ("0", 0), ("18", 10)])
def test_luhn_sum(spark, digits, total):
    assert spark.range(1).select(pii.luhn_sum(F.lit(digits))).first()[0] == total == luhn(digits)


@pytest.mark.parametrize(
    "value",
    ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005",
     "3782 822463 10005", "3056 930902 5904"],
)
def test_short_numbers_beside_a_card(spark, value):
    around = ["{}", "{} 123", "12 {}", "7 {} 12", "1-{}-22", "{} 1", "123 {} 123", "{} {}"]
    for row, text in zip(safe(spark, [a.replace("{}", value) for a in around]), around):
        assert {tuple(f) for f in row.found} == {("card", value, card(value))}
        assert row.safe_text == text.replace("{}", card(value))


def test_other_groups_are_still_found(spark):
    values = ["123456 7890123", "41111-1111 111-11111", "12 345678 901234", "4111-1111-1111-1111-123"]
    for row, value in zip(safe(spark, values), values):
        assert [f.value for f in row.found] == [value] and row.safe_text != value
