"""Date predicates that reach the Parquet scan."""

from pyspark.sql import Column, functions as F


def year_is(c, year: int) -> Column:
    """``year(c) = year`` as a half-open range.

    The function call is opaque to the scan; the range is pushed down as ``>=``
    and ``<`` and prunes row groups and date partitions.
    """
    c = F.col(c) if isinstance(c, str) else c
    start = F.make_date(F.lit(year), F.lit(1), F.lit(1))
    end = F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))
    return (c >= start) & (c < end)
