"""Line counts by event time: tumbling windows that are closed by a watermark.

The lines of each micro-batch are counted by window and stored; these counts, few and of
fixed size, are the stream that Spark aggregates under a watermark in append mode. A
window is written once, when the watermark passes its end, and then leaves the state.
Counts that come later are late: they are in the stored counts and in no window, so the
difference is exact. All that one call brings counts as arriving at once.
"""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from ..sources.storage import exists, fresh_dir
from .clock import append, event_time, state_rows
from .logs import LiveTable

WINDOW = "1 day"
DELAY = "1 hour"


def _counts(window: str):
    def counts(lines: DataFrame) -> DataFrame:
        timed = lines.withColumn("ts", event_time())
        # A line without a time belongs to no window; ``window`` would leave it out.
        start = F.window(F.coalesce("ts", F.lit("1970-01-01").cast("timestamp")), window)["start"]
        return timed.groupBy(
            F.when(F.col("ts").isNotNull(), start).alias("window_start"), "stream"
        ).agg(F.count("*").alias("n"), F.max("ts").alias("newest"))

    return counts


@dataclass(frozen=True)
class WindowTotals:
    """Counts per window and stream at ``path``. One call of ``fill`` at a time."""

    path: str
    window: str = WINDOW
    delay: str = DELAY
    #: Rows of state after the last call, None before.
    state: int | None = None

    def _arrivals(self) -> LiveTable:
        return LiveTable(f"{self.path}/arrivals", _counts(self.window))

    def fill(self, lines: DataFrame) -> "WindowTotals":
        arrivals = self._arrivals()
        arrivals.fill(lines)
        spark = lines.sparkSession
        if not exists(spark, arrivals.rows_path):
            return self
        schema = arrivals.rows(lines).schema
        counts = spark.readStream.schema(schema).parquet(arrivals.rows_path)
        closed = (
            counts.withWatermark("newest", self.delay)
            .groupBy(F.window("newest", self.window), "stream")
            .agg(F.sum("n").alias("n"))
            .select(F.col("window.start").alias("window_start"), "stream", "n")
        )
        return replace(self, state=state_rows(append(closed, spark, f"{self.path}/closed")))

    def rows(self, lines: DataFrame) -> DataFrame:
        """``window_start, stream, n, late, closed``: ``n`` lines came in time, ``late``
        after the window was closed. Lines without a time are late, in no window."""
        spark = lines.sparkSession
        keys = ["window_start", "stream"]
        arrived = self._arrivals().rows(lines).groupBy(*keys).agg(F.sum("n").alias("arrived"))
        schema = arrived.withColumnRenamed("arrived", "n").schema
        if self.state is None:
            counted = spark.createDataFrame([], schema).withColumn("closed", F.lit(True))
        else:
            closed = spark.read.schema(schema).parquet(f"{self.path}/closed/rows")
            opened = spark.read.format("statestore").load(f"{self.path}/closed/checkpoint")
            opened = opened.select(
                F.col("key.window.start").alias("window_start"),
                F.col("key.stream").alias("stream"),
                F.col("value.*"),
            ).toDF(*keys, "n")
            counted = closed.withColumn("closed", F.lit(True)).unionByName(
                opened.withColumn("closed", F.lit(False))
            )
        counted = counted.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "closed")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        n = F.coalesce("n", F.lit(0))
        return arrived.join(counted, same[0] & same[1], "left").select(
            F.col("window_start").cast("timestamp_ntz").alias("window_start"),
            "stream",
            n.alias("n"),
            (F.col("arrived") - n).alias("late"),
            F.coalesce("closed", F.lit(True)).alias("closed"),
        )


def log_window_totals(
    lines: DataFrame, path: str | None = None, window: str = WINDOW, delay: str = DELAY
) -> DataFrame:
    """Lines per window of ``ts`` and stream. Call again with the same ``path`` to go on."""
    totals = WindowTotals(path or fresh_dir(lines.sparkSession, "log_windows"), window, delay)
    return totals.fill(lines).rows(lines)
