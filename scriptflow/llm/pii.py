"""Format-preserving pseudonyms for personal data; built-in functions only.

Numbers and dates are found by pattern, validated, and replaced by a keyed
permutation of themselves within their format: an equal value has an equal pseudonym
in every document, two values never share one, and a pseudonym is itself a valid
value of its kind. Separators, country codes and brackets stay where they are.

The permutation is a Feistel network. A value is a pair of numbers ``(a, b)`` below
``(m, n)``; four rounds in turn add to one a keyed hash of the other, modulo its
bound. So every round can be undone and the pair stays below its bounds; no domain
needs to be a power of anything.

==========  =======================================  ====================  ===========
kind        valid if                                 domain                ``m, n``
==========  =======================================  ====================  ===========
card        13 to 19 digits, Luhn sum divisible      all but the check     halves
            by ten                                   digit, which follows
phone       ten digits of a North American number,   the ten digits        10^5, 10^5
            with or without ``+1``
ssn         area 1-899 but 666, group 1-99,          area, group; serial   88902, 9999
            serial 1-9999
ip          four octets of at most 255               the octets            2^16, 2^16
date        a day from 1901 to 2096, as              the day in its 28     21, 487
            ``yyyy-mm-dd`` or ``dd/mm/yyyy``         years of the calendar
email       a name, an ``@`` and a domain            the name's letters    by character
                                                     and digits
secret      32 to 64 hexadecimal digits in a row     letters and digits    by character
number      13 to 19 digits that are no card         all digits            halves
==========  =======================================  ====================  ===========

Names and secrets are permuted half by half, each character within its class (digit,
lower or upper case letter, hexadecimal letters for secrets).

A number of 13 to 19 digits is unbroken or in groups such as 4-4-4-4 and 4-6-5; a short
number beside such a one is not part of it. Digits in other groups are taken as one number.

Defined cases: a null text stays null, an empty one stays empty; what is not valid
stays as it is; every row of a repeated document gets the same result.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Key of the registered query. Give a secret one of your own in earnest.
KEY = "example key, not a secret"
ROUNDS = 4

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"
_IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
_ISO = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
_DMY = r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
#: Groups that numbers are written in, with one separator throughout.
_GROUPS = [(x, g) for x in " -" for g in ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3))]
_WRITTEN = "|".join(
    [r"\d{13,19}", r"\d{4}-\d{4}-\d{4}-\d{4}-\d{3}"]
    + [x.join(rf"\d{{{n}}}" for n in g) for x, g in _GROUPS]
)
_WRITTEN = rf"(?:{_WRITTEN})(?!\d)"
#: Other groups count too, but never run into a number that is written as above.
_DIGITS = rf"(?<!\d)(?:{_WRITTEN}|\d(?:\d|[ -](?!{_WRITTEN})\d){{12,18}}(?!\d))"
PATTERN = "|".join((_EMAIL, _SECRET, _IP, _ISO, _DMY, _SSN, _PHONE, _DIGITS))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.transform(F.array(value), body)[0]


def _hash(key: str, label: str, *parts: Column) -> Column:
    """60 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), F.lit(label), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def feistel(key: str, kind: str, a: Column, b: Column, m: Column, n: Column) -> Column:
    """A permutation of the pairs ``(a, b)`` with ``a < m`` and ``b < n``."""
    pair = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def step(x: Column, k: Column) -> Column:
        # The bounds are part of the hash: formats of other sizes are unrelated.
        even = F.pmod(x["a"] + F.pmod(_hash(key, kind, m, n, k, x["b"]), m), m)
        odd = F.pmod(x["b"] + F.pmod(_hash(key, kind, m, n, k, x["a"]), n), n)
        return F.struct(
            F.when(k % 2 == 0, even).otherwise(x["a"]).alias("a"),
            F.when(k % 2 == 1, odd).otherwise(x["b"]).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, step)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _number(c: Column, start: int, length: int | Column) -> Column:
    return F.substr(c, F.lit(start), F.lit(length) if isinstance(length, int) else length).cast("bigint")


def _padded(c: Column, width) -> Column:
    """``c`` with zeros in front."""
    text = c.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.lit(width) - F.char_length(text)), text)


def _refilled(match: Column, old: Column, new: Column) -> Column:
    """``match`` with its digits ``old``, which are its last ones, replaced."""
    first = F.char_length(_digits(match)) - F.char_length(old)
    start = F.struct(F.lit("").alias("out"), (-first).alias("at"))

    def filled(new: Column) -> Column:
        def put(x: Column, c: Column) -> Column:
            digit = c.rlike("[0-9]")
            char = F.when(digit & (x["at"] >= 0), F.substr(new, x["at"] + 1, F.lit(1)))
            return F.struct(
                F.concat(x["out"], char.otherwise(c)).alias("out"),
                (x["at"] + digit.cast("int")).alias("at"),
            )

        return F.aggregate(F.split(match, ""), start, put, lambda x: x["out"])

    return _let(new, filled)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, of which the last counts once."""

    def total(digits: Column) -> Column:
        def add(total: Column, k: Column) -> Column:
            d = F.substr(digits, F.char_length(digits) - k + 1, F.lit(1)).cast("int")
            twice = d * 2 - F.when(d > 4, 9).otherwise(0)
            return total + F.when(k % 2 == 0, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add)

    return _let(digits, total)


def _in_halves(key: str, kind: str, digits: Column) -> Column:
    power = lambda k: F.rpad(F.lit("1"), k + 1, F.lit("0")).cast("bigint")

    def permuted(digits: Column) -> Column:
        left = F.floor(F.char_length(digits) / 2).cast("int")
        right = F.char_length(digits) - left
        new = feistel(
            key,
            kind,
            _number(digits, 1, left),
            F.substr(digits, left + 1, right).cast("bigint"),
            power(left),
            power(right),
        )
        return _let(
            new, lambda new: F.concat(_padded(new["a"], left), _padded(new["b"], right))
        )

    return _let(digits, permuted)


def _card(key: str, digits: Column) -> Column:
    body = F.substr(digits, F.lit(1), F.char_length(digits) - 1)

    def checked(new: Column) -> Column:
        check = F.pmod(-luhn_sum(F.concat(new, F.lit("0"))), F.lit(10))
        return F.concat(new, check.cast("string"))

    return _let(_in_halves(key, "card", body), checked)


def _ssn(key: str, digits: Column) -> Column:
    area = _number(digits, 1, 3)
    rank = (area - F.when(area > 666, 2).otherwise(1)) * 99 + _number(digits, 4, 2) - 1

    def written(new: Column) -> Column:
        area = F.floor(new["a"] / 99) + 1
        area = area + F.when(area >= 666, 1).otherwise(0)
        return F.concat(
            _padded(area, 3), _padded(new["a"] % 99 + 1, 2), _padded(new["b"] + 1, 4)
        )

    serial = _number(digits, 6, 4) - 1
    return _let(feistel(key, "ssn", rank, serial, F.lit(88902), F.lit(9999)), written)


def _ip(key: str, match: Column) -> Column:
    octet = lambda k: F.split_part(match, F.lit("."), F.lit(k)).cast("bigint")
    size = F.lit(1 << 16)

    def written(new: Column) -> Column:
        parts = [f(new[c]) for c in ("a", "b") for f in (lambda x: F.floor(x / 256), lambda x: x % 256)]
        return F.concat_ws(".", *[p.cast("string") for p in parts])

    a, b = octet(1) * 256 + octet(2), octet(3) * 256 + octet(4)
    return _let(feistel(key, "ip", a, b, size, size), written)


#: 28 years between 1901 and 2099 have this many days, 21 times 487.
_CYCLE = 10227


def _day(match: Column) -> Column:
    """The date that a match stands for; NULL if there is none."""
    iso = F.when(match.rlike(r"^\d{4}-"), match).otherwise(
        F.concat_ws("-", F.substring(match, 7, 4), F.substring(match, 4, 2), F.substring(match, 1, 2))
    )
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")


def _date(key: str, match: Column) -> Column:
    start = F.lit("1901-01-01").cast("date")

    def moved(since: Column) -> Column:
        day = since % _CYCLE
        new = feistel(key, "date", F.floor(day / 487), day % 487, F.lit(21), F.lit(487))
        return _let(new, lambda new: since - day + new["a"] * 487 + new["b"])

    date = F.date_add(start, _let(F.datediff(_day(match), start), moved).cast("int"))
    return F.when(match.rlike(r"^\d{4}-"), F.date_format(date, "yyyy-MM-dd")).otherwise(
        F.date_format(date, "dd/MM/yyyy")
    )


def _shifted(key: str, kind: str, text: Column, other: Column, k: Column, letters: int) -> Column:
    """``text`` with each character moved in its class by a keyed hash of ``other``."""

    def move(c: Column, i: Column) -> Column:
        by = _hash(key, kind, k, i, other)
        base = F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65)
        size = F.when(base == 48, 10).otherwise(letters)
        new = F.chr(base + F.pmod(F.ascii(c) - base + F.pmod(by, size), size))
        return F.coalesce(new, c)

    return F.array_join(F.transform(F.split(text, ""), move), "")


def _by_character(key: str, kind: str, text: Column, letters: int) -> Column:
    half = F.floor(F.char_length(text) / 2).cast("int")
    pair = F.struct(
        F.substr(text, F.lit(1), half).alias("a"),
        F.substr(text, half + 1, F.char_length(text) - half).alias("b"),
    )

    def step(x: Column, k: Column) -> Column:
        return F.struct(
            F.when(k % 2 == 0, _shifted(key, kind, x["a"], x["b"], k, letters))
            .otherwise(x["a"])
            .alias("a"),
            F.when(k % 2 == 1, _shifted(key, kind, x["b"], x["a"], k, letters))
            .otherwise(x["b"])
            .alias("b"),
        )

    steps = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(steps, pair, step, lambda x: F.concat(x["a"], x["b"]))


def kind_of(match: Column) -> Column:
    """The kind of what the pattern found; NULL if it is not valid."""
    whole = lambda p: match.rlike(f"^(?:{p})$")
    digits = _digits(match)
    octets = F.split(match, r"\.")
    day = _day(match)
    area = _number(digits, 1, 3)
    good_ssn = (
        area.between(1, 899)
        & (area != 666)
        & (_number(digits, 4, 2) > 0)
        & (_number(digits, 6, 4) > 0)
    )
    return (
        F.when(whole(_EMAIL), "email")
        .when(whole(_SECRET), "secret")
        .when(
            whole(_IP), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), F.lit("ip"))
        )
        .when(
            whole(_ISO) | whole(_DMY),
            F.when((day >= "1901-01-01") & (day <= "2096-12-31"), F.lit("date")),
        )
        .when(whole(_SSN), F.when(good_ssn, F.lit("ssn")))
        .when(whole(_PHONE), "phone")
        .when(luhn_sum(digits) % 10 == 0, "card")
        .otherwise("number")
    )


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    """What replaces a match of a kind; the match itself for a null kind."""
    digits = _digits(match)
    name = F.substring_index(match, "@", 1)
    ten = F.substr(digits, F.char_length(digits) - 9, F.lit(10))
    new_phone = _in_halves(key, "phone", ten)
    return (
        F.when(
            kind == "email",
            F.concat(
                _by_character(key, "email", name, 26),
                F.substr(match, F.char_length(name) + 1),
            ),
        )
        .when(kind == "secret", _by_character(key, "secret", match, 6))
        .when(kind == "ip", _ip(key, match))
        .when(kind == "date", _date(key, match))
        .when(kind == "ssn", _refilled(match, digits, _ssn(key, digits)))
        .when(kind == "phone", _refilled(match, ten, new_phone))
        .when(kind == "card", _refilled(match, digits, _card(key, digits)))
        .when(kind == "number", _refilled(match, digits, _in_halves(key, "number", digits)))
        .otherwise(match)
    )


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """For every document: ``document``, a struct of its columns, ``safe_text``, and
    ``found``, an array of ``kind, value, pseudonym``."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
        F.col("text").alias("_text"),
    )
    matches = F.when(
        F.col("_text").rlike(PATTERN), F.regexp_extract_all("_text", F.lit(PATTERN), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))

    def replaced(match: Column) -> Column:
        return _let(
            kind_of(match),
            lambda kind: F.struct(
                kind.alias("kind"),
                match.alias("value"),
                pseudonym(match, kind, key).alias("pseudonym"),
            ),
        )

    # An array function is computed once where its result is exploded or filtered
    # below, so matches and pseudonyms are columns of their own.
    rows = rows.withColumn("_found", F.transform(matches, replaced))
    between = F.split("_text", PATTERN)
    ends = F.concat(F.transform("_found", lambda x: x["pseudonym"]), F.array(F.lit("")))
    safe = F.when(F.size("_found") == 0, F.col("_text")).otherwise(
        F.array_join(F.zip_with(between, ends, lambda a, b: F.concat(a, b)), "")
    )
    return rows.select(
        "document",
        safe.alias("safe_text"),
        F.filter("_found", lambda x: x["kind"].isNotNull()).alias("found"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind))
    return pseudonymize(docs, KEY).select(
        "document.doc_id",
        F.col("safe_text").alias("text"),
        F.size("found").cast("bigint").alias("n_found"),
        *[count(kind).alias(f"n_{kind}") for kind in ("card", "phone", "ip", "email", "secret")],
    )
