"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

A text becomes a few statistics of its bytes, words and lines. Random Fourier
features of the standardised statistics approximate a Gaussian kernel. Every
partition of the labelled rows sums its part of the normal equations; the sums fit
ridge scores, and a monotone step function turns scores into probabilities.

The model is a few hundred numbers, whatever the size of the input: the driver sees
one sum for each block of the equations and at most ``BINS`` rows of counts.

Defined cases: a null text counts as empty and is scored like any other; rows
without a label, or with a null ``doc_id`` or label, are not learned from; labels
given more than once count by their mean; if there are no labels at all, or of one
kind only, every score is the share of good labels (1.0 without any).
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.storage import stage
from . import words

#: Number of random features, of score bins for the calibration, and of row blocks
#: in which the normal equations are summed.
FEATURES = 256
BINS = 1024
BLOCKS = 8
#: Rows without which no task of the fit is worth starting.
ROWS_PER_TASK = 50_000
SEED = 7
RIDGE = 1e-3
BANDWIDTH = 1.0
KEEP_AT = 0.7

_KINDS = np.zeros((256, 10), np.float64)
for _kind, _bytes in enumerate(
    (
        range(ord("a"), ord("z") + 1),
        range(ord("A"), ord("Z") + 1),
        range(ord("0"), ord("9") + 1),
        range(128, 256),
        b" ",
        b"\n",
        b".,;:",
        b"!?",
        b"#$%&*+=<>@^~",
        b"|/\\_-()[]{}\"'`",
    )
):
    _KINDS[list(_bytes), _kind] = 1

#: Statistics of a text, in order.
STATISTICS = (
    *("lower", "upper", "digit", "non_ascii", "space", "line_break"),
    *("stop", "shout", "symbol", "bracket", "control"),
    *("log_bytes", "log_words", "word_length", "word_spread", "short_words", "long_words"),
    *("distinct_words", "repeated_words", "log_line", "distinct_lines"),
)


def _mean(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return total / np.maximum(n, 1)


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each of ``n`` owners has."""
    keys = (owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    keys.sort()
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[first] >> np.uint64(40)).astype(np.int64), minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text of a block."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256)
    kinds = counts @ _KINDS
    control = size - kinds.sum(axis=1)
    share = _mean(np.column_stack([kinds, control]), size[:, None])

    starts, ends = words.word_bounds(data, offsets)
    sums = words.prefix_sums(data)
    hashes = words.range_hashes(sums, starts, ends)
    at = np.searchsorted(starts, offsets)
    n_words = np.diff(at)
    of = np.repeat(np.arange(n), n_words)
    length = (ends - starts).astype(np.float64)
    total = lambda x: np.bincount(of, weights=x, minlength=n)
    mean_length = _mean(total(length), n_words)
    spread = np.sqrt(np.maximum(_mean(total(length**2), n_words) - mean_length**2, 0))
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])

    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(offsets[:-1][size > 0], breaks + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_of = np.searchsorted(offsets, line_starts, "right") - 1
    lines = np.bincount(line_of, minlength=n)
    line_hashes = words.range_hashes(sums, line_starts, line_ends)

    return np.column_stack(
        [
            np.sqrt(share),
            np.log1p(size) / 4,
            np.log1p(n_words) / 4,
            np.log1p(mean_length),
            np.log1p(spread),
            _mean(total(length <= 3), n_words),
            _mean(total(length >= 14), n_words),
            _mean(_distinct(of, hashes, n), n_words) ** 2,
            _mean(total(again), n_words),
            np.log1p(_mean(size, lines)) / 4,
            _mean(_distinct(line_of, line_hashes, n), lines),
        ]
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def text_statistics(texts: pd.Series) -> pd.Series:
    """``STATISTICS`` of each text."""
    parts = [
        statistics(data, offsets)
        for _, _, data, offsets in words.blocks(pa.array(texts, pa.large_string()))
    ]
    return pd.Series([row for part in parts for row in part], dtype=object)


@dataclass
class Model:
    """What scoring needs. ``knots`` and ``levels`` are the calibration."""

    center: np.ndarray = field(default_factory=lambda: np.zeros(len(STATISTICS)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(STATISTICS)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    levels: np.ndarray = field(default_factory=lambda: np.ones(1))

    def features(self, stats: np.ndarray) -> np.ndarray:
        """The random Fourier features of rows of statistics, and a constant."""
        rng = np.random.default_rng(SEED)
        d = len(STATISTICS)
        directions = rng.normal(0, BANDWIDTH / np.sqrt(d), (d, FEATURES))
        phases = rng.uniform(0, 2 * np.pi, FEATURES)
        # Far values are held at a distance at which the kernel has died down.
        x = np.clip((stats - self.center) / self.scale, -8, 8)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ directions + phases)
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def _matrix(stats: pd.Series) -> np.ndarray:
    return np.vstack(stats.to_numpy()) if len(stats) else np.zeros((0, len(STATISTICS)))


def scores(model: Model, stats: Column) -> Column:
    """The calibrated score of statistics, 0 to 1."""

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(column)))

    return score(stats)


def _equations(model: Model):
    """Sums of a partition: per block of rows of the matrix, its part and that of
    the right-hand side."""

    def add(batches):
        gram = np.zeros((FEATURES + 1, FEATURES + 1))
        right = np.zeros(FEATURES + 1)
        for batch in batches:
            rows = batch.to_pandas()
            z = model.features(_matrix(rows["stats"]))
            w = rows["weight"].to_numpy()
            gram += (z * w[:, None]).T @ z
            right += z.T @ (w * rows["label"].to_numpy())
        both = np.column_stack([gram, right])
        for k, part in enumerate(np.array_split(both, BLOCKS)):
            yield pa.RecordBatch.from_pydict({"block": [k], "sums": [part.tobytes()]})

    return add


def _add_up(batches):
    """The sum of a partition's sums, block by block."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, sums in zip(*(batch.column(c).to_pylist() for c in ("block", "sums"))):
            part = np.frombuffer(sums)
            total[k] = total[k] + part if k in total else part
    for k, part in total.items():
        yield pa.RecordBatch.from_pydict({"block": [k], "sums": [part.tobytes()]})


_SUMS = "block bigint, sums binary"


def isotonic(at: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ``n`` labels, ``good`` of them 1, at rising
    scores. Returns knots and levels for linear interpolation."""
    pools: list[list[float]] = []
    for x, g, m in zip(at, good, n):
        pools.append([x, x, g, m])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, last, g, m = pools.pop()
            pools[-1][1:] = last, pools[-1][2] + g, pools[-1][3] + m
    knots = np.array([x for p in pools for x in p[:2]])
    levels = np.array([(p[2] + 0.05) / (p[3] + 0.1) for p in pools for _ in range(2)])
    return knots, np.maximum.accumulate(levels)


def fit(labelled: DataFrame) -> Model:
    """Learn from rows of ``stats, label, calibrate``.

    Rows with ``calibrate`` set shape the calibration, the others the scores.
    """
    model = Model()
    d = len(STATISTICS)
    learn = labelled.filter(~F.col("calibrate"))
    x = [F.col("stats")[k] for k in range(d)]
    row = learn.agg(
        *[F.avg(c) for c in x],
        *[F.stddev_pop(c) for c in x],
        F.count("*"),
        F.avg("label"),
    ).first()
    n, rate = row[2 * d], row[2 * d + 1]
    if not n or rate in (0.0, 1.0):
        model.levels[:] = 1.0 if rate is None else rate
        return model
    model.center = np.array(row[:d])
    model.scale = np.maximum(np.array(row[d : 2 * d]), 0.02)

    # Both kinds of label weigh the same.
    weight = F.when(F.col("label") == 1, 0.5 / rate).otherwise(0.5 / (1 - rate))
    tasks = max(1, min(n // ROWS_PER_TASK, 4096))
    sums = (
        learn.select("stats", F.col("label").cast("double"), weight.alias("weight"))
        .coalesce(tasks)
        .mapInArrow(_equations(model), _SUMS)
        .repartition(BLOCKS, "block")
        .mapInArrow(_add_up, _SUMS)
        .collect()
    )
    both = np.concatenate(
        [np.frombuffer(r.sums).reshape(-1, FEATURES + 2) for r in sorted(sums)]
    )
    gram = both[:, :-1] + RIDGE * n * np.eye(FEATURES + 1)
    model.weights = np.linalg.solve(gram, both[:, -1])

    @F.pandas_udf("double")
    def raw(stats: pd.Series) -> pd.Series:
        return pd.Series(model.raw(_matrix(stats)))

    bins = (
        labelled.filter("calibrate")
        .select(F.round((raw("stats") + 1) * (BINS / 3)).alias("bin"), "label")
        .withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(BINS), F.col("bin"))))
        .groupBy("bin")
        .agg(F.sum("label").alias("good"), F.count("*").alias("n"))
        .orderBy("bin")
        .collect()
    )
    if bins:
        at, good, n = (np.array([r[k] for r in bins], float) for k in range(3))
        model.knots, model.levels = isotonic(at * 3 / BINS - 1, good, n)
    else:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def remainder(doc_id: Column, n: int) -> Column:
    """``crc32`` of the id as text, modulo ``n``; NULL for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and ``doc_id, held_out, stats`` of every document, staged.

    Of the labelled rows outside the held-out quarter, two thirds shape the scores
    and one third the calibration.
    """
    part = remainder(F.col("doc_id"), 4)
    stats = stage(
        docs.select(
            "doc_id",
            F.coalesce(part == 2, F.lit(False)).alias("held_out"),
            text_statistics(F.coalesce("text", F.lit(""))).alias("stats"),
        ),
        "quality_statistics",
    )
    good = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    )
    labelled = stage(
        stats.filter("not held_out and doc_id is not null")
        .join(good, "doc_id")
        .select("stats", "label", (part == 3).alias("calibrate")),
        "quality_labelled",
    )
    return fit(labelled), stats


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model, stats = train(docs, labels)
    return stats.select(
        "doc_id", "held_out", scores(model, F.col("stats")).alias("score")
    ).withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model, _ = train(docs, labels)
    score = scores(model, text_statistics(F.coalesce("text", F.lit(""))))
    return docs.filter(score >= KEEP_AT)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return classify(read("documents"), read("labels"))
