"""Benchmark decontamination with spaced seeds.

A mask such as ``1101011`` selects word positions; the words under it are hashed at
every place of a text. Positions that a mask leaves out may hold any word, so a
passage in which words were replaced still shares hashes with the original. The
masks below find every passage of ten words of which two were replaced, and so each
that counts; items of six to nine words have masks of their own.

The hashes of a bounded block of benchmark items are sent to all tasks, which join
them with the hashes of their documents. Around each hit, item and document are
aligned and compared word by word: a segment counts if at least four of five words
are equal and at least ``SEGMENT`` words are, or four of five of the item's, and five.
Of several the one with most equal words is reported. Benchmarks of more than
``BLOCK_WORDS`` words are searched for block by block.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``, lower-cased A-Z; punctuation
at their ends does not count.

Defined cases: a null text has no words and is clean; items of fewer than five words,
or null, are not searched for; a null item id is reported as null; items that are alike are all reported; no items leave
every document clean; every row of a repeated document gets its own result.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.storage import stage
from . import words

#: Five words each.
MASKS = ("11111", "1101011", "11011001", "10100111", "1110101")
#: One replaced word in an item of fewer than ten words.
SHORT_MASKS = ("101111", "110111", "111011", "111101")
#: Words that must be equal in a segment, and the share of its words that must be.
SEGMENT = 13
LEAST_WORDS = 5
#: Score of a word that differs, where one that is equal scores 1: at most one of
#: five words differs in a segment of a score of 0 or more.
MISS = -4.0
#: Benchmark words whose hashes are sent to the tasks at once.
BLOCK_WORDS = 500_000

_FACTORS = np.random.default_rng(5).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLAG_BITS = 22
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}")] = True

HITS = "array<struct<item_id: bigint, start: bigint, words: bigint, equal: bigint>>"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words without punctuation at their ends, and where texts begin."""
    starts, ends = words.word_bounds(data, offsets)
    at = np.searchsorted(starts, offsets)
    while True:
        cut = (ends > starts) & _EDGE[data[np.minimum(starts, len(data) - 1)]] if len(starts) else starts
        if not cut.any():
            break
        starts = starts + cut
    while True:
        cut = (ends > starts) & _EDGE[data[ends - 1]] if len(starts) else starts
        if not cut.any():
            break
        ends = ends - cut
    hashes = words.range_hashes(words.prefix_sums(words.lowered(data)), starts, ends)
    full = ends > starts
    return hashes[full], np.concatenate([[0], np.cumsum(full)])[at]


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    n = max(len(hashes) - len(mask) + 1, 0)
    out = np.zeros(n, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += hashes[k : k + n] * _FACTORS[k]
    return words.mixed(out)


class Index:
    """The seeds of a block of items, ready to be searched in documents."""

    def __init__(self, item_ids: list[int], texts: list[str]):
        column = pa.array(texts, pa.large_string())
        found = [_words(data, offsets) for _, _, data, offsets in words.blocks(column, 2**62)]
        self.words, self.at = found[0] if found else (np.zeros(0, np.uint64), np.zeros(1, int))
        self.ids = item_ids
        size = np.diff(self.at)
        short = ((size > LEAST_WORDS) & (size < 10)).any()
        self.masks = [*MASKS, *(SHORT_MASKS if short else ())]
        self.tables = []
        for mask in self.masks:
            seeds = _seeds(self.words, mask)
            item = np.searchsorted(self.at, np.arange(len(seeds)), "right") - 1
            inside = np.arange(len(seeds)) + len(mask) <= self.at[item + 1]
            place = np.flatnonzero(inside)
            order = np.argsort(seeds[place], kind="stable")
            seeds, place = seeds[place][order], place[order]
            flags = np.zeros(1 << _FLAG_BITS, bool)
            flags[seeds >> np.uint64(64 - _FLAG_BITS)] = True
            self.tables.append((seeds, place, flags))

    def diagonals(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pairs of a text and of where the benchmark's words would begin in the
        words of the block, for every hit; and the item: rows of three numbers."""
        found = []
        for mask, (seeds, place, flags) in zip(self.masks, self.tables):
            own = _seeds(hashes, mask)
            near = np.flatnonzero(flags[own >> np.uint64(64 - _FLAG_BITS)])
            low = np.searchsorted(seeds, own[near], "left")
            n = np.searchsorted(seeds, own[near], "right") - low
            near, low, n = near[n > 0], low[n > 0], n[n > 0]
            text = np.searchsorted(at, near, "right") - 1
            inside = near + len(mask) <= at[text + 1]
            near, low, n, text = near[inside], low[inside], n[inside], text[inside]
            steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            there = place[np.repeat(low, n) + steps]
            item = np.searchsorted(self.at, there, "right") - 1
            found.append(np.column_stack([np.repeat(text, n), np.repeat(near, n) - there, item]))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple]]:
        """The verified hits of each text of a block."""
        out: list[dict[tuple, None]] = [{} for _ in offsets[1:]]
        hashes, at = _words(data, offsets)
        for text, shift, item in self.diagonals(hashes, at) if len(self.words) else ():
            first, last = self.at[item], self.at[item + 1]
            low = max(first, at[text] - shift)
            high = min(last, at[text + 1] - shift)
            equal = hashes[low + shift : high + shift] == self.words[low:high]
            segment = verified(equal, int(last - first))
            if segment:
                start, n, same = segment
                hit = (self.ids[item], int(low + shift + start - at[text]), n, same)
                out[text][hit] = None
        return [list(hits) for hits in out]


def verified(equal: np.ndarray, item_words: int) -> tuple[int, int, int] | None:
    """The segment of aligned words with most equal ones, of those in which at least
    four of five are, as start, words and equal words, if it is enough."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, MISS))])
    count = np.concatenate([[0], np.cumsum(equal)])
    # For each end the first start from which the score is not negative.
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums, "left")
    same = count - count[starts]
    end = int(np.argmax(same))
    if same[end] < max(LEAST_WORDS, min(SEGMENT, math.ceil(0.8 * item_words))):
        return None
    start = int(starts[end])
    start += int(np.argmax(equal[start:end]))
    return start, end - start, int(same[end])


def _found(items) -> Column:
    @F.pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(*items.value)
        for texts in batches:
            out = []
            for _, _, data, offsets in words.blocks(pa.array(texts, pa.large_string())):
                out += index.search(data, offsets)
            yield pd.Series(out, dtype=object)

    return hits(F.coalesce(F.col("document.text").cast("string"), F.lit("")))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every document: ``document``, a struct of its columns, and ``hits``, the
    verified segments, counted in words of the text."""
    spark = docs.sparkSession
    items = stage(
        benchmark.filter("text is not null").select(
            F.col("item_id").cast("bigint").alias("item_id"),
            "text",
            F.size(F.split("text", r"\s+")).alias("words"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "benchmark_items",
    )
    total = items.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(total / BLOCK_WORDS))
    result = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
        F.array().cast(HITS).alias("hits"),
    )
    for k in range(n_blocks):
        if k:  # one block in a task at a time
            result = stage(result, "decontamination_block")
        block = items.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(
            ([r.item_id for r in block], [r.text for r in block])
        )
        result = result.select("document", F.concat("hits", _found(shared)).alias("hits"))
    return result


def report(found: DataFrame) -> DataFrame:
    """One row for each document of ``find``."""
    return found.select(
        "document.doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.col("hits.item_id"))).alias("item_ids"),
        F.size("hits").cast("bigint").alias("n_hits"),
        F.coalesce(F.array_max("hits.equal"), F.lit(0)).alias("longest"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark passage, with their columns."""
    return find(docs, benchmark).filter(F.size("hits") == 0).select("document.*")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return report(find(read("documents"), read("benchmark")))
