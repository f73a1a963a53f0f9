"""What attempts printed, or a note, while both still arrive.

Attempts, ``(run_id, attempt, started, exit_code)``, and log lines with ``ts`` are joined as
streams under watermarks. A line belongs to an attempt that started no later than the line
and at most ``span`` earlier; both leave the state when no partner can come any more, and
then an attempt without lines is written alone. What is stored are joined rows; the texts
are put together when they are read, by the batch operator.
"""

from datetime import datetime

from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.runlog import ATTEMPT, PART_LINES, output_or_note
from ..sources.storage import fresh_dir
from .clock import append, event_time, state_rows, with_ticks, without_ticks

SPAN = "1 day"
DELAY = "10 minutes"
_LINE = ["seq", "stream", "line"]


def join_outputs(
    attempts: DataFrame,
    lines: DataFrame,
    path: str,
    span: str = SPAN,
    delay: str = DELAY,
    upto: datetime | str | None = None,
) -> int:
    """Write the attempts and lines that found each other, and the attempts that can find
    no line any more, to ``path``; the rows of state that stay."""
    spark = attempts.sparkSession
    left = attempts.select(*ATTEMPT, "exit_code", event_time("started").alias("started"))
    left = with_ticks(left, "started", f"{path}/ticks", upto).withWatermark("started", delay)
    left = without_ticks(left, "started")
    right = lines.select(*ATTEMPT, *_LINE, event_time().alias("ts"))
    right = with_ticks(right, "ts", f"{path}/ticks").withWatermark("ts", delay)
    right = without_ticks(right, "ts").withColumnsRenamed({c: f"line_{c}" for c in ATTEMPT})
    same = " AND ".join(f"{c} = line_{c}" for c in ATTEMPT)
    joined = left.join(
        right,
        F.expr(f"{same} AND ts >= started AND ts <= started + INTERVAL {span}"),
        "leftOuter",
    ).select(*ATTEMPT, "exit_code", *_LINE)
    return state_rows(append(joined, spark, path))


def joined_outputs(
    spark, path: str, schema: T.StructType, part_lines: int = PART_LINES
) -> DataFrame:
    """``run_id, attempt, part, output`` of the attempts written so far."""
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    # One row for each attempt, whatever the number of its lines.
    attempts = rows.select(*ATTEMPT, "exit_code").distinct()
    return output_or_note(attempts, rows.filter("seq IS NOT NULL"), part_lines)


def live_output_or_note(
    attempts: DataFrame,
    lines: DataFrame,
    path: str | None = None,
    span: str = SPAN,
    delay: str = DELAY,
    upto: datetime | str | None = None,
    part_lines: int = PART_LINES,
) -> DataFrame:
    """The outputs of the attempts that are settled. Call again with the same ``path`` to
    go on; an attempt that still prints grows with the calls."""
    spark = attempts.sparkSession
    path = path or fresh_dir(spark, "live_outputs")
    join_outputs(attempts, lines, path, span, delay, upto)
    fields = [attempts.schema[c] for c in (*ATTEMPT, "exit_code")]
    schema = T.StructType([*fields, *[lines.schema[c] for c in _LINE]])
    return joined_outputs(spark, path, schema, part_lines)
