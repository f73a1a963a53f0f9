"""Statistics that are kept by day and merged when they are read.

Counts are exact. Numbers of distinct values are HyperLogLog sketches, quantiles are KLL
sketches; both merge in any order, so a day is summarised once and any range of days is read
from a few small rows. An estimate of distinct values has a relative standard error of about
1.04 / 2^(``LG_REGISTERS`` / 2); a quantile's rank is off by about 1.8 / ``ITEMS`` of all
rows at most. Up to some thousand values of either kind both are exact.
"""

from pyspark.sql import DataFrame, functions as F

LG_REGISTERS = 14
ITEMS = 4096


def sketches(rows: DataFrame, day: str, who: str, value: str) -> DataFrame:
    """``day, n, who, value`` with a sketch of the distinct ``who`` and one of ``value``.
    NULLs count in ``n`` only."""
    return rows.groupBy(F.col(day).alias("day")).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(F.col(who), LG_REGISTERS).alias("who"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), ITEMS).alias("value"),
    )


def merged(kept: DataFrame, *by) -> DataFrame:
    """``by, n, who, value`` over some days."""
    return kept.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("who").alias("who"),
        F.kll_merge_agg_double("value").alias("value"),
    )


def report(kept: DataFrame, *by, quantiles=(0.5, 0.9)) -> DataFrame:
    """``by, n, distinct_who`` and a column for each quantile, as ``q50``."""
    whole = merged(kept, *by)
    names = [c for c in whole.columns if c not in ("n", "who", "value")]
    return whole.select(
        *names,
        "n",
        F.hll_sketch_estimate("who").alias("distinct_who"),
        *[
            F.kll_sketch_get_quantile_double("value", F.lit(q)).alias(f"q{round(100 * q)}")
            for q in quantiles
        ],
    )
