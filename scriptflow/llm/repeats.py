"""Removal of repeated passages with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a
document with a smaller id, or further left in the same one. Texts are UTF-8 bytes,
strings never cross texts, and all is judged on the input.

1. Every string of ``LENGTH`` bytes has an anchor: of the ``GRAM``-byte strings in it,
   the leftmost with the smallest hash. Equal strings have equal anchors at the same
   place in them, so only strings of one anchor have to be compared. Strings with the
   same anchor lie side by side and are one region.
2. Anchors that occur once are dropped; this is a count, combined before the shuffle.
   Of regions that are equal as a whole, all but the first are repeats, however many
   there are.
3. The first regions of an anchor, as far as they differ, are sorted: their bytes,
   cut into cells of eight that are aligned at the anchor, are the symbols of a text
   whose suffix array is built (``suffixes.py``). Strings whose cells have the same
   run in the array, and whose bytes before and after the cells are equal, are equal;
   all but the first are repeats. Anchors with more than ``SORTED_REGIONS`` different
   regions are not gathered into one task: their strings are grouped by Spark, with
   the same result.
4. The repeats of a document are united and cut out.

Anchors and regions are told apart by 64 bits of hashes; what is sorted, is compared
byte by byte.

Defined cases: a null text counts as empty; a null id comes before all others; rows
with equal ids are ordered by a hash of their text, and rows with equal ids and texts
are one document, each of them with its result; a text shorter than ``LENGTH`` stays.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..sources.storage import stage
from . import words
from .suffixes import suffix_array

LENGTH = 100
GRAM = 32
CELL = 8
#: Different regions of an anchor that are sorted in one task, and of all anchors of
#: a task together.
SORTED_REGIONS = 20_000
TASK_REGIONS = 20_000
#: Bytes in which anchors are searched for at once.
_SEGMENT = 1 << 22
_PLACE_BITS = 24


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def regions(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """The regions of a block of texts: hash of the anchor, hash of the region, its
    text, its start, its number of strings, and the place of the anchor in it."""
    out = [[np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 4]
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for at in range(0, len(data) - length + 1, _SEGMENT):
        part = data[at : at + _SEGMENT + length - 1]
        sums = words.prefix_sums(part)
        hashes = words.window_hashes(sums, gram)
        low_bits = np.uint64(_PLACE_BITS)
        keys = hashes >> low_bits << low_bits
        keys |= np.arange(len(hashes), dtype=np.uint64)
        anchor = (_least(keys, length - gram + 1) & np.uint64((1 << _PLACE_BITS) - 1)).view(np.int64)
        text = owner[at : at + len(anchor)]
        inside = text == owner[at + length - 1 : at + length - 1 + len(anchor)]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(anchor))
        begin, stop = begin[inside[begin]], stop[inside[begin]]
        place = anchor[begin] - begin
        whole = words.range_hashes(sums, begin, stop - 1 + length)
        out.append(
            [
                hashes[anchor[begin]],
                words.mixed(whole + place.astype(np.uint64)),
                text[begin],
                begin + at - offsets[text[begin]],
                stop - begin,
                place,
            ]
        )
    return [np.concatenate(c) for c in zip(*out)]


_REGION = "anchor long, region long, start long, strings int, place int"


def _found(length: int, gram: int, anchors_only: bool):
    names = ["anchor"] if anchors_only else ["anchor", "region", "start", "strings", "place"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def find(batches):
        for batch in batches:
            for first, _, data, offsets in words.blocks(batch.column(2)):
                anchor, region, text, *rest = regions(data, offsets, length, gram)
                columns = [anchor.view(np.int64), region.view(np.int64), *rest]
                arrays = [pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds)]
                arrays = arrays[: len(names)]
                if not anchors_only:
                    text = pa.array(text + first)
                    arrays = [batch.column(0).take(text), batch.column(1).take(text), *arrays]
                ids = [] if anchors_only else ["doc_id", "text_hash"]
                yield pa.RecordBatch.from_arrays(arrays, names=[*ids, *names])

    return find


def _packed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Up to seven bytes from each start as a number."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(CELL - 1):
        more = k < sizes
        byte = data[np.where(more, starts + k, 0)]
        out = np.where(more, out << np.uint64(8) | byte, out)
    return out


def repeated_strings(
    texts: list[bytes], strings: np.ndarray, place: np.ndarray, length: int
) -> np.ndarray:
    """Which strings of the regions have an equal one further up in the list.

    ``strings[k]`` strings start at the first bytes of ``texts[k]``, whose anchor is
    at ``place[k]``. A flag for each string, region after region.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    base = np.cumsum(size) - size
    lead = place % CELL  # bytes before the first cell
    cells = (size - lead) // CELL
    cell_base = np.cumsum(cells + 1) - (cells + 1)  # a separator after each region

    of = np.repeat(np.arange(len(texts)), cells)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    at = base[of] + lead[of] + nth * CELL
    values = np.zeros(len(of), np.uint64)
    for k in range(CELL):
        values = values << np.uint64(8) | data[at + k]
    symbols = np.zeros(int((cells + 1).sum()), np.int64)
    symbols[cell_base[of] + nth] = np.unique(values, return_inverse=True)[1] + 1

    array = suffix_array(symbols)
    rank = np.empty(len(array), np.int64)
    rank[array] = np.arange(len(array))

    # The strings: bytes before their first cell, whole cells, bytes after them.
    of = np.repeat(np.arange(len(texts)), strings)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
    before = (lead[of] - nth) % CELL
    whole = (length - before) // CELL
    after = length - before - whole * CELL
    begin = base[of] + nth
    first_cell = cell_base[of] + (nth + before - lead[of]) // CELL
    run = np.zeros(len(of), np.int64)
    padded = np.concatenate([symbols, np.full(length, -1)])
    same = np.ones(len(array), bool)
    same[:1] = False
    wanted = set(np.unique(whole).tolist())
    for k in range(length // CELL + 1):
        if k in wanted:
            runs = np.cumsum(~same)
            now = whole == k
            run[now] = runs[rank[first_cell[now]]]
        same[1:] &= padded[array[1:] + k] == padded[array[:-1] + k]
    left = _packed(data, begin, before)
    right = _packed(data, begin + before + whole * CELL, after)
    order = np.lexsort((left, right, run * CELL + before))
    again = np.ones(len(of), bool)
    again[:1] = False
    for key in (left, right, run, before):
        key = key[order]
        again[1:] &= key[1:] == key[:-1]
    out = np.zeros(len(of), bool)
    out[order] = again
    return out


_INTERVALS = "doc_id {id}, text_hash long, begin long, stop long"


def _sorted(length: int, doc_id: pa.DataType):
    def sort(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        # Null ids first, then by id, text and start; rows are few and fixed in width.
        table = table.sort_by(
            [("no_id", "descending"), ("doc_id", "ascending"), ("text_hash", "ascending"), ("start", "ascending")]
        )
        strings = table["strings"].to_numpy().astype(np.int64)
        place = table["place"].to_numpy().astype(np.int64)
        again = repeated_strings(table["bytes"].to_pylist(), strings, place, length)
        of = np.repeat(np.arange(len(strings)), strings)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
        new = again.copy()
        new[1:] &= ~again[:-1] | (of[1:] != of[:-1])
        last = again.copy()
        last[:-1] &= ~again[1:] | (of[1:] != of[:-1])
        rows = of[new]
        start = table["start"].to_numpy()[rows]
        take = pa.array(rows)
        return pa.table(
            {
                "doc_id": table["doc_id"].take(take),
                "text_hash": table["text_hash"].take(take),
                "begin": pa.array(start + nth[new]),
                "stop": pa.array(start + nth[last] + length),
            }
        )

    return sort


def _order(doc_id: str = "doc_id", start: str = "start") -> Column:
    """What comes first: the smallest of these."""
    return F.struct(
        F.col(doc_id).isNotNull().alias("has_id"),
        F.col(doc_id).alias("doc_id"),
        F.col("text_hash"),
        F.col(start).alias("start"),
    )


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, text_hash, begin, stop``: ranges of bytes that are repeats. They may
    overlap. ``docs`` has ``doc_id, text_hash, text``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    repeated = (
        docs.mapInArrow(_found(length, gram, True), "anchor long")
        .groupBy("anchor")
        .count()
        .filter("count > 1")
        .select("anchor")
    )
    found = docs.mapInArrow(
        _found(length, gram, False), f"doc_id {id_type}, text_hash long, {_REGION}"
    )
    found = stage(found.join(repeated, "anchor"), "repeat_regions")

    firsts = stage(
        found.groupBy("anchor", "region")
        .agg(
            F.min(_order()).alias("first"),
            F.max("strings").alias("strings"),
            F.max("place").alias("place"),
            F.count("*").alias("n"),
        )
        .select("anchor", "region", "first", "strings", "place", "n"),
        "repeat_firsts",
    )
    copies = (
        found.join(firsts.filter("n > 1").select("anchor", "region", "first"), ["anchor", "region"])
        .filter(_order() != F.col("first"))
        .select(
            "doc_id",
            "text_hash",
            F.col("start").alias("begin"),
            (F.col("start") + F.col("strings") - 1 + length).alias("stop"),
        )
    )

    several = firsts.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    differ = firsts.join(several, "anchor").select(
        "first.doc_id",
        "first.text_hash",
        F.struct("anchor", "first.start", "strings", "place", "kinds").alias("r"),
    )
    lists = differ.groupBy("doc_id", "text_hash").agg(F.collect_list("r").alias("list"))
    lists = lists.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash")
    same_text = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    once = docs.join(lists, same_text).dropDuplicates(["doc_id", "text_hash"])
    known = once.select(
        "doc_id", "text_hash", F.col("text").cast("binary").alias("raw"), F.explode("list").alias("r")
    ).select(
        "doc_id",
        "text_hash",
        "r.*",
        F.substring("raw", F.col("r.start").cast("int") + 1, F.col("r.strings") - 1 + length).alias("bytes"),
    )
    known = stage(known, "repeat_bytes")
    many = known.agg(F.count("*")).first()[0]
    buckets = max(1, math.ceil(many / TASK_REGIONS))

    fits = F.col("kinds") <= SORTED_REGIONS
    sorted_ = (
        known.filter(fits)
        .withColumn("no_id", F.col("doc_id").isNull())
        .withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInArrow(_sorted(length, None), _INTERVALS.format(id=id_type))
    )
    each = known.filter(~fits).select(
        "anchor",
        "doc_id",
        "text_hash",
        F.explode(F.sequence(F.lit(0), F.col("strings") - 1)).alias("nth"),
        "start",
        "bytes",
    )
    each = each.select(
        "anchor",
        "doc_id",
        "text_hash",
        (F.col("start") + F.col("nth")).alias("begin"),
        F.substring("bytes", F.col("nth") + 1, F.lit(length)).alias("string"),
    )
    earliest = each.groupBy("anchor", "string").agg(
        F.min(_order(start="begin")).alias("first"), F.count("*").alias("n")
    )
    grouped = (
        each.join(earliest.filter("n > 1"), ["anchor", "string"])
        .filter(_order(start="begin") != F.col("first"))
        .select("doc_id", "text_hash", "begin", (F.col("begin") + length).alias("stop"))
    )
    return copies.unionByName(sorted_).unionByName(grouped)


def _cut(batches):
    """Unite the ranges of each text and cut them out."""
    for batch in batches:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        kept, spans = [], []
        for text, ranges in zip(texts, batch.column(1).to_pylist()):
            united: list[list[int]] = []
            for begin, stop in sorted((r["begin"], r["stop"]) for r in ranges or ()):
                if united and begin <= united[-1][1]:
                    united[-1][1] = max(united[-1][1], stop)
                else:
                    united.append([begin, stop])
            edges = [0, *(e for span in united for e in span), len(text or b"")]
            kept.append(b"".join((text or b"")[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"begin": a, "stop": b} for a, b in united])
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[2:],
                pa.array(kept, pa.binary()),
                pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))),
            ],
            names=[*batch.schema.names[2:], "kept", "spans"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """For every document: ``doc_id, n_bytes``, ``kept``, its bytes without repeats,
    and ``spans``, the ranges that were cut out."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    ranges = repeats(docs, length, gram).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("begin", "stop")).alias("ranges")
    )
    ranges = ranges.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash")
    same_text = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    rows = docs.join(ranges, same_text, "left").select(
        "text", "ranges", "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes")
    )
    schema = T.StructType(
        [
            *rows.schema.fields[2:],
            *T._parse_datatype_string(
                "kept binary, spans array<struct<begin: bigint, stop: bigint>>"
            ).fields,
        ]
    )
    return rows.mapInArrow(_cut, schema)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Bytes are read as two hexadecimal digits each; strings are compared by their MD5.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n
  FROM documents
), parts AS (
  SELECT doc_id, least(512, n - 99 - c) AS m, c, substr(h, 2 * c + 1, 2 * (512 + 99)) AS part
  FROM (SELECT doc_id, h, n, unnest(range(0, n - 99, 512)) AS c FROM d)
), strings AS (
  SELECT doc_id, c + i AS s, md5(substr(part, 2 * i + 1, 200)) AS k
  FROM (SELECT doc_id, c, part, unnest(range(0, m)) AS i FROM parts)
), repeated AS (
  SELECT doc_id, s
  FROM strings
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1
), marked AS (
  SELECT doc_id, s,
         CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS opens
  FROM repeated
), numbered AS (
  SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked
), spans AS (
  SELECT doc_id, min(s) AS b, max(s) + 100 AS e FROM numbered GROUP BY doc_id, span
), cut AS (
  SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS p FROM spans
)
SELECT d.doc_id, any_value(d.n) AS n_bytes,
       CAST(coalesce(sum(e - b), 0) AS BIGINT) AS n_removed,
       count(b) AS n_spans,
       sha256(unhex(
         coalesce(string_agg(substr(h, 2 * p + 1, 2 * (b - p)), '' ORDER BY b), '')
         || substr(any_value(h), 2 * coalesce(max(e), 0) + 1)
       )) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
GROUP BY d.doc_id
"""
