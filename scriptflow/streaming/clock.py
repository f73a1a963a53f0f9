"""Ticks that carry event time on when a log falls silent.

A watermark moves with the rows of a stream. When no more rows come, the last windows,
attempts and joins would stay open for ever. A tick is a row that belongs to no attempt
and says only what time it is.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.storage import exists

#: The attempt that ticks carry; attempts are counted from 1.
TICK = -1


def event_time(c="ts"):
    """A column of times as watermarks need it; local times are times of the session."""
    return F.col(c).cast("timestamp")


def with_ticks(
    stream: DataFrame, time: str, path: str, upto: datetime | str | None = None
) -> DataFrame:
    """``stream`` and the ticks at ``path``, to which ``upto`` adds one.

    A tick has ``TICK`` as its ``attempt``, ``upto`` as ``time``, zero as ``run_id`` and
    nothing else. It is no NULL: a join would leave those out before they are seen.
    """
    spark = stream.sparkSession
    schema = "ts timestamp"
    if upto is not None or not exists(spark, path):
        tick = spark.range(1).select(F.lit(upto or "1970-01-02").cast("timestamp").alias("ts"))
        tick.write.mode("append").parquet(path)
    ticks = spark.readStream.schema(schema).parquet(path)
    values = {time: F.col("ts"), "run_id": F.lit(0), "attempt": F.lit(TICK)}
    columns = [
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema
    ]
    return stream.unionByName(ticks.select(*columns))


def without_ticks(timed: DataFrame, time: str) -> DataFrame:
    """``timed``, which has its watermark, without its ticks. The condition names the time,
    so that Spark does not move it to where the ticks have not been seen yet."""
    return timed.filter((F.col("attempt") != TICK) | (F.col(time) < F.lit("0001-01-02").cast("timestamp")))


def append(frame: DataFrame, spark: SparkSession, path: str):
    """Add what has arrived to the table at ``path``, then stop; the finished query."""
    query = (
        frame.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def state_rows(query) -> int:
    """The rows of state that a finished query keeps."""
    progress = query.recentProgress
    return sum(op.numRowsTotal for op in progress[-1].stateOperators) if progress else 0
