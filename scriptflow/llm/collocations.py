"""Phrases whose words occur together more than their parts would lead to expect.

SON partitioning: a phrase with ``support`` occurrences in a language has its share of
them, ``support`` times the shard's part of all words, in one shard at least. Each shard
is mined completely at that lowered support, the phrases that are frequent in some shard
are united, and all of these are counted exactly over the whole corpus.

A shard is no task. Documents are dealt into ``SHARDS`` by hash, and every shard is mined
by all tasks together, length by length: tasks count the phrases of a batch of texts, the
counts of a shard are added up by an exchange, and a phrase is counted only if the phrases
it is made of were frequent in its shard. So a shard may have any size, a source or a
document of a third of all rows is spread over shards and tasks, and the lowered support
does not sink to one as the corpus grows.

While shards are mined, phrases are 64-bit hashes, and what is frequent is handed to the
next length as a Bloom filter of at most ``FILTER_BITS`` bits. Both only ever let too much
through: a filter never loses a phrase, and in the end phrases are counted as strings.

Texts have A-Z in lower case; they are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these
into words ``[^\\x20\\x09]+``. Occurrences may overlap and never cross a piece.

Defined cases: a null text is empty, an empty one has no words; a null language is
``und``; repeated rows count each; a language without frequent phrases has no rows; ties
are broken by the phrase's bytes; other columns are not read.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.storage import stage
from . import words
from .graphs import limited

SUPPORT = 30
#: Longest phrase.
LENGTH = 4
#: Reported phrases of a language.
TOP = 2000
#: A phrase goes if a longer one has this share of its occurrences.
COVERED = (80, 100)
#: Scores are whole numbers up to half of this.
SCALE = 2_000_000
#: Parts of the corpus that are mined on their own, at most 16. They need not be many, as
#: every one is mined by all tasks; the fewer they are, the higher is their support.
SHARDS = 3
#: Bits of a filter, 16 MB: 14 million phrases at 9 bits each. With more it lets more through.
FILTER_BITS = 1 << 27
#: Bytes of text whose phrases are counted at once.
BATCH_BYTES = 1_000_000
#: Phrases that are written out at once.
BATCH_PHRASES = 100_000

#: A cell is a shard of a language and a length: ``(lang_id * SHARDS + shard) * _LENGTHS + length``.
_LENGTHS = 8
_PROBES = 4
_CHUNK_BITS = 1 << 19
_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAPS = _PIECE_ENDS.copy()
_GAPS[[0x20, 0x09]] = True


class _Words:
    """The words of some texts: ``start`` and ``end`` in ``data``, the ``row`` of their
    text, and ``run``, the number of words from each on to the end of its piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = words.lowered(data)
        inside = ~_GAPS[data]
        outside = np.append(~inside, True)
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        self.start = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | cut[:-1]))
        self.end = np.flatnonzero(inside & (outside[1:] | cut[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        n = len(self.start)
        # A piece ends between two words where one of its ends or of the text's lies.
        cuts = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_PIECE_ENDS[data], out=cuts[1:])
        piece = cuts[self.start] if n else np.zeros(0, np.int64)
        new = np.ones(n + 1, bool)
        if n:
            new[1:-1] = (piece[1:] != piece[:-1]) | (self.row[1:] != self.row[:-1])
        stops = np.flatnonzero(new[1:])
        self.run = stops[np.cumsum(new[:-1]) - 1] - np.arange(n) + 1 if n else piece
        self.hash = words.range_hashes(words.prefix_sums(self.data), self.start, self.end)

    def phrases(self, length: int) -> np.ndarray:
        """Where phrases of this many words begin."""
        return np.flatnonzero(self.run >= length)

    def keys(self, at: np.ndarray, length: int) -> np.ndarray:
        """Their hashes."""
        out = words.mixed(self.hash[at] + np.uint64(length))
        for k in range(1, length):
            out = words.mixed(out ^ self.hash[at + k])
        return out

    def texts(self, at: np.ndarray, length: int) -> pa.Array:
        """The phrases themselves, with a blank between words."""
        size = self.end - self.start + 1
        before = np.concatenate([[0], np.cumsum(size)])
        # All words with a blank behind each: a phrase is a range of these bytes.
        row = np.full(before[-1], 0x20, np.uint8)
        row[_ranges(before[:-1], size - 1)] = self.data[_ranges(self.start, size - 1)]
        first = before[at]
        n = before[at + length] - 1 - first
        ends = np.concatenate([[0], np.cumsum(n)])
        return pa.LargeStringArray.from_buffers(
            len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(row[_ranges(first, n)])
        )


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that begin at ``start`` and have ``n`` numbers."""
    if not len(n):
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1])


class _Filter:
    """A Bloom filter that tasks read; None lets everything through."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for place in _places(keys, len(self.bits) * 8):
            rest = np.flatnonzero(out)
            place = place[rest]
            out[rest] = (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
        return out


def _places(keys: np.ndarray, n_bits: int) -> Iterator[np.ndarray]:
    step = words.mixed(keys) | np.uint64(1)
    for k in range(_PROBES):
        yield ((keys + np.uint64(k) * step) & np.uint64(n_bits - 1)).astype(np.int64)


def _salted(keys: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Keys of a shard, or of a language."""
    return words.mixed(keys ^ words.mixed(salt.view(np.uint64)))


def _filter(keys: DataFrame) -> _Filter:
    """A filter with the column ``key``, distinct. Its size follows from the number of keys
    up to ``FILTER_BITS``; tasks set bits chunk by chunk, and the driver gets the bits."""
    n = keys.count()
    n_bits = min(FILTER_BITS, max(_CHUNK_BITS, 1 << math.ceil(math.log2(9 * n + 1))))

    def places(batches):
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            place = np.unique(np.concatenate(list(_places(key, n_bits))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place // _CHUNK_BITS), pa.array((place % _CHUNK_BITS).astype(np.int32))],
                ["chunk", "place"],
            )

    def chunk(
        group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_CHUNK_BITS, bool)
        for batch in batches:
            bits[batch.column(1).to_numpy()] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([group[0].as_py()]), pa.array([packed])], ["chunk", "bits"])

    placed = keys.mapInArrow(places, "chunk long, place int").groupBy("chunk")
    chunks = placed.applyInArrow(chunk, "chunk long, bits binary")
    bits = np.zeros(n_bits // 8, np.uint8)
    for row in chunks.collect():
        at = row.chunk * (_CHUNK_BITS // 8)
        bits[at : at + _CHUNK_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    return _Filter(bits)


def _shared(spark: SparkSession, filters: dict[int, _Filter]):
    return spark.sparkContext.broadcast({k: f.bits for k, f in filters.items()})


def _promising(found: _Words, length: int, salt: np.ndarray, filters: dict) -> np.ndarray:
    """Where the phrases of a length begin of which all parts passed: those one word
    shorter, or the longest shorter ones that there is a filter for."""
    at = found.phrases(length)
    part = max((k for k in filters if k < length), default=0)
    if not part:
        return at
    have = np.zeros(len(found.start) + 1, bool)
    parts = found.phrases(part)
    keys = _salted(found.keys(parts, part), salt[found.row[parts]])
    have[parts[filters[part].has(keys)]] = True
    for k in range(length - part + 1):
        at = at[have[at + k]]
    return at


def _texts(batches, n_before: int):
    """The words of a bounded number of bytes of texts, with the columns before them."""
    for batch in batches:
        text = batch.column(n_before)
        for first, last, data, offsets in words.blocks(text, BATCH_BYTES):
            before = [
                batch.column(k).slice(first, last - first).to_numpy(zero_copy_only=False)
                for k in range(n_before)
            ]
            yield before, _Words(data, offsets)


def _mined(lengths, shared):
    """Counts of phrases by language, shard and hash, from the texts of a task."""

    def mined(batches):
        filters = {k: _Filter(b) for k, b in shared.value.items()}
        for (lang, shard), found in _texts(batches, 2):
            own = lang * SHARDS + shard
            for length in lengths:
                at = _promising(found, length, own, filters)
                if not len(at):
                    continue
                keys, groups = found.keys(at, length), own[found.row[at]]
                mixed = _salted(keys, groups)
                order = np.argsort(mixed)
                mixed = mixed[order]
                new = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))
                first = order[new]
                counts = np.diff(np.append(new, len(keys)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(groups[first] * _LENGTHS + length),
                        pa.array(keys[first].view(np.int64)),
                        pa.array(counts.astype(np.int64)),
                    ],
                    names=["cell", "key", "n"],
                )

    return mined


def _counted(shared):
    """Counts of the candidates by language and phrase, from the texts of a task."""

    def counted(batches):
        filters = {k: _Filter(b) for k, b in shared.value.items()}
        for (lang,), found in _texts(batches, 1):
            for length, passed in filters.items():
                at = found.phrases(length)
                owner = lang[found.row[at]]
                kept = passed.has(_salted(found.keys(at, length), owner))
                at, owner = at[kept], owner[kept]
                for k in range(0, len(at), BATCH_PHRASES):
                    some = slice(k, k + BATCH_PHRASES)
                    table = pa.table({"lang": owner[some], "phrase": found.texts(at[some], length)})
                    table = table.group_by(["lang", "phrase"]).aggregate([([], "count_all")])
                    yield from pa.table(
                        {
                            "lang": table["lang"],
                            "phrase": table["phrase"].cast(pa.string()),
                            "length": pa.array(np.full(len(table), length, np.int8)),
                            "n": table["count_all"],
                        }
                    ).combine_chunks().to_batches()

    return counted


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lang_id, shard, text`` of the documents, and the names of the ids, which are
    hashes of 56 bits, so that an id, a shard and a length are one number."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.select(
        F.shiftrightunsigned(F.xxhash64(lang), 8).alias("lang_id"),
        F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(SHARDS)).alias("shard"),
        F.col("text").cast("string").alias("text"),
        lang.alias("lang"),
    ).filter("text <> ''")
    names = stage(rows.select("lang_id", "lang").distinct(), "phrase_languages")
    return rows.drop("lang"), names


def frequent_phrases(docs: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, length, f`` of all phrases of up to ``LENGTH`` words with at least
    ``support`` occurrences in their language, and ``lang, n``, the words of each."""
    spark = docs.sparkSession
    rows, names = _numbered(docs)
    filters: dict[int, _Filter] = {}
    united = None
    lowered = None
    shard = F.expr(f"cell div {_LENGTHS}")
    for lengths in ((1,), (2,), tuple(range(3, LENGTH + 1))):
        shared = _shared(spark, filters)
        counts = (
            rows.mapInArrow(_mined(lengths, shared), "cell long, key long, n long")
            # Tasks have combined what is equal; to do so again would fill their memory.
            .repartition("cell", "key")
            .groupBy("cell", "key")
            .agg(F.sum("n").alias("n"))
        )
        if lowered is None:
            counts = stage(counts, "phrase_words")
            sizes = stage(
                counts.groupBy(shard.alias("shard"), F.expr(f"cell div {_LENGTHS * SHARDS}").alias("lang_id"))
                .agg(F.sum("n").alias("words")),
                "phrase_shards",
            )
            totals = sizes.groupBy("lang_id").agg(F.sum("words").alias("total"))
            # ceil(support * words / total), in decimals: products may pass 64 bits.
            need = F.expr(
                f"CAST((CAST({support} AS DECIMAL(38, 0)) * words + total - 1) div total AS BIGINT)"
            )
            lowered = limited(sizes.join(totals, "lang_id").select("shard", need.alias("need")), 40)
        frequent = stage(
            counts.withColumn("shard", shard)
            .join(lowered, "shard")
            .filter("n >= need")
            .select("cell", "key"),
            f"phrases_{lengths[0]}",
        )
        if lengths[-1] < LENGTH:
            own = frequent.mapInArrow(_with_salt(1), "key long, length byte")
            filters = {**filters, lengths[-1]: _filter(own.select("key"))}
        united = frequent if united is None else united.unionByName(frequent)
        shared.unpersist()

    candidates = stage(
        united.mapInArrow(_with_salt(SHARDS), "key long, length byte").distinct(), "phrase_candidates"
    )
    lengths = [r[0] for r in candidates.select("length").distinct().collect()]
    passed = {k: _filter(candidates.filter(F.col("length") == k).select("key")) for k in sorted(lengths)}
    counted = rows.select("lang_id", "text").mapInArrow(
        _counted(_shared(spark, passed)), "lang long, phrase string, length byte, n long"
    )
    counted = (
        counted.repartition("lang", "phrase", "length")
        .groupBy(F.col("lang").alias("lang_id"), "phrase", "length")
        .agg(F.sum("n").alias("f"))
        .filter(F.col("f") >= support)
    )
    small = limited(names, 100 + F.length("lang"))
    phrases = counted.join(small, "lang_id").select("lang", "phrase", "length", "f")
    total = sizes.groupBy("lang_id").agg(F.sum("words").alias("n"))
    return stage(phrases, "phrases"), stage(total.join(small, "lang_id").select("lang", "n"), "words")


def _with_salt(divisor: int):
    """Keys for a filter: of the shard, or of the language if shards are divided."""

    def with_salt(batches):
        for batch in batches:
            key = batch.column(1).to_numpy().view(np.uint64)
            cell = batch.column(0).to_numpy()
            salted = _salted(key, cell // (_LENGTHS * divisor))
            yield pa.RecordBatch.from_arrays(
                [pa.array(salted.view(np.int64)), pa.array((cell % _LENGTHS).astype(np.int8))],
                ["key", "length"],
            )

    return with_salt


def _parts(phrase: Column, start, n) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def collocations(
    docs: DataFrame, support: int = SUPPORT, top: int = TOP, covered: tuple[int, int] = COVERED
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: of each language the ``top`` phrases of
    two words and more that are not covered by a longer one."""
    phrases, totals = frequent_phrases(docs, support)
    f = lambda name: phrases.select(
        "lang", F.col("phrase").alias(f"{name}_part"), F.col("f").alias(name)
    )
    cuts = phrases.filter("length > 1").select(
        "lang",
        "phrase",
        "length",
        F.col("f").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"),
    )
    cuts = cuts.withColumns(
        {
            "l_part": _parts(F.col("phrase"), F.lit(1), F.col("k")),
            "r_part": _parts(F.col("phrase"), F.col("k") + 1, F.col("length").cast("int")),
        }
    )
    score = F.expr(
        f"CAST((CAST({SCALE} AS DECIMAL(38, 0)) * a) div (CAST(l AS DECIMAL(38, 0)) + r) AS BIGINT)"
    )
    scored = (
        cuts.join(f("l"), ["lang", "l_part"])
        .join(f("r"), ["lang", "r_part"])
        .withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    # All shorter parts of the longer phrases, with the most frequent phrase around each.
    inner = phrases.filter("length > 2").select(
        "lang",
        "phrase",
        "f",
        "length",
        F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("size"),
    )
    inner = inner.select(
        "lang",
        "f",
        "phrase",
        "size",
        F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)).alias("start"),
    )
    around = (
        inner.select("lang", "f", _parts(F.col("phrase"), F.col("start"), F.col("size")).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    num, den = covered
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    kept = (
        scored.join(around, ["lang", "phrase"], "left")
        .filter(F.col("longer").isNull() | (wide("longer") * den < wide("a") * num))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First the best of each salt, so that no task has a whole language.
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    by_salt = Window.partitionBy("lang", "salt").orderBy(*order)
    best = salted.withColumn("rank", F.row_number().over(by_salt)).filter(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    best = best.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.join(limited(totals, 100 + F.length("lang")), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, len, unnest(list_transform(range(1, len(ws) - len + 2),
    lambda i: array_to_string(ws[i:i + len - 1], ' '))) AS phrase
  FROM w, range(1, {LENGTH + 1}) AS t(len) WHERE len(ws) >= len
), f AS (
  SELECT lang, len, phrase, count(*) AS f FROM g GROUP BY ALL
), c AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE len > 1 AND f >= {SUPPORT}
), cuts AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r,
         (({SCALE}::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:len(ws)], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (
  SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i
        FROM (SELECT *, unnest(range(2, len(ws))) AS size FROM c))
  GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM scored s LEFT JOIN around o USING (lang, phrase)
  WHERE longer IS NULL OR {COVERED[1]} * longer < {COVERED[0]} * a
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len = 1 GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
