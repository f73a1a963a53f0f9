"""Attempts that are closed as they end.

A stream of process events, ``(run_id, attempt, ts, kind, exit_code)``, where ``kind`` is
``line`` or ``status``. An attempt ends with its status row: that is a verdict at once and
needs no state. If none comes, the attempt ends when the watermark has passed its last
event by ``silence``, with the exit code that stands for none. The state for that is a
session window for each open attempt, a few numbers that leave the state when the session
closes. Everything is built in; no row passes through Python.

A status that arrives later than that, however late, is written as well and wins when the
table is read, so the verdicts are those of the whole log in any order of arrival.
"""

from datetime import datetime

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.runlog import ATTEMPT, NO_EXIT_CODE, exit_code
from ..sources.storage import fresh_dir
from .clock import append, event_time, state_rows, with_ticks, without_ticks

SILENCE = "1 hour"
DELAY = "10 minutes"
_FIRST = "1970-01-02"


def close_attempts(
    events: DataFrame,
    path: str,
    silence: str = SILENCE,
    delay: str = DELAY,
    upto: datetime | str | None = None,
) -> int:
    """Write the verdicts that the events bring to ``path``; the rows of state that stay.

    ``upto`` tells that the log is complete up to that time. An event without a time is
    taken as one of the log's first.
    """
    slim = events.select(*ATTEMPT, event_time().alias("ts"), "kind", "exit_code")
    slim = slim.withColumn("ts", F.coalesce("ts", F.lit(_FIRST).cast("timestamp")))
    ended = slim.filter("kind = 'status'").select(
        *ATTEMPT, exit_code().cast("int").alias("exit_code"), F.lit("status").alias("closed_by"), "ts"
    )
    timed = with_ticks(slim, "ts", f"{path}/ticks", upto).withWatermark("ts", delay)
    silent = (
        without_ticks(timed, "ts")
        .groupBy(F.session_window("ts", silence), *ATTEMPT)
        .agg(F.bool_or(F.col("kind") == "status").alias("ended"))
        .filter(~F.col("ended"))
        .select(
            *ATTEMPT,
            F.lit(NO_EXIT_CODE).alias("exit_code"),
            F.lit("timeout").alias("closed_by"),
            F.col("session_window.end").alias("ts"),
        )
    )
    return state_rows(append(ended.unionByName(silent), events.sparkSession, path))


def verdicts(spark, path: str, keys: list[T.StructField]) -> DataFrame:
    """``run_id, attempt, exit_code, exit_ok, closed_by`` of the closed attempts. ``keys``
    are the fields of the first two. Of several statuses the first one counts."""
    schema = T.StructType(keys).add("exit_code", T.IntegerType())
    schema = schema.add("closed_by", T.StringType()).add("ts", T.TimestampType())
    first = F.struct("closed_by", "ts", "exit_code")  # a status before a time-out
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    rows = rows.groupBy(*ATTEMPT).agg(F.min(first).alias("v"))
    return rows.select(
        *ATTEMPT, "v.exit_code", (F.col("v.exit_code") == 0).alias("exit_ok"), "v.closed_by"
    )


def attempt_closed(
    events: DataFrame,
    path: str | None = None,
    silence: str = SILENCE,
    delay: str = DELAY,
    upto: datetime | str | None = None,
) -> DataFrame:
    """The verdicts of all attempts that have ended. Call again with the same ``path`` to
    go on."""
    spark = events.sparkSession
    path = path or fresh_dir(spark, "attempts_closed")
    close_attempts(events, path, silence, delay, upto)
    return verdicts(spark, path, [events.schema[c] for c in ATTEMPT])
