"""Jobs over attempts: what each led to, and how each run ended.

Columns: ``(run_id, attempt, exit_code, code, suggestion, stage_error)``. A
``stage_error`` of ``analysis`` or ``save`` means that the script was not run, one of
``stream`` that its output could not be read to the end: such an attempt has failed,
whatever its exit code, and goes on to correction.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import linediff
from ..functions.text import fill, strip_ws
from .runlog import (
    ATTEMPT,
    PART_LINES,
    STREAM,
    STREAM_ERROR_NOTE,
    exit_code,
    with_output,
)

# Fixed value: attempts per run unless the user asks for another number.
MAX_ATTEMPTS = 3
MAX_ATTEMPTS_RANGE = range(1, 11)

# What an attempt can lead to.
ACTIONS = [
    "analysis_error",
    "save_error",
    "success",
    "max_attempts",
    "no_suggestion",
    "same_code",
    "retry",
]

SAME_CODE_NOTE = "\n\n[note] the reply repeats the code; the run stops here"
NO_SUGGESTION_NOTE = "\n\n[note] no reply to go on with; the run stops here"
STAGE_ERROR_NOTE = "[note] the script was not run: %s"


def _has_suggestion() -> Column:
    return F.coalesce(F.col("suggestion") != "", F.lit(False))


def _differs() -> Column:
    return ~F.equal_null(strip_ws("suggestion"), strip_ws("code"))


def suggestion_changed(attempts: DataFrame) -> DataFrame:
    """Whether there is a suggestion, and whether it is other code."""
    return attempts.select(
        *ATTEMPT,
        _has_suggestion().alias("has_suggestion"),
        (_has_suggestion() & _differs()).alias("changed"),
    )


def _action_code(max_attempts: int) -> Column:
    """Place in ``ACTIONS`` of what an attempt leads to: the first rule that holds."""
    if max_attempts not in MAX_ATTEMPTS_RANGE:
        raise ValueError(f"max_attempts must be 1 to 10, not {max_attempts}")
    code = ACTIONS.index
    return (
        F.when(F.col("stage_error") == "save", code("save_error"))
        .when(F.col("stage_error") != STREAM, code("analysis_error"))
        .when((exit_code() == 0) & F.col("stage_error").isNull(), code("success"))
        .when(F.col("attempt") >= max_attempts, code("max_attempts"))
        .when(~_has_suggestion(), code("no_suggestion"))
        .when(~_differs(), code("same_code"))
        .otherwise(code("retry"))
    )


def _action_name(code) -> Column:
    return F.get(F.array(*(F.lit(a) for a in ACTIONS)), code)


def attempt_action(
    attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """What each attempt leads to. Any ``stage_error`` but ``save`` and ``stream``
    counts as one of the analysis."""
    return attempts.select(
        *ATTEMPT, _action_name(_action_code(max_attempts)).alias("action")
    )


def _final_attempts(attempts: DataFrame, max_attempts: int) -> DataFrame:
    """The first attempt per run that does not lead to another one; NULLs if none.

    Attempt and action travel as one number. With texts among the aggregates, Spark
    would sort the attempts before it combines them.
    """
    code = F.col("code")
    rank = F.when(
        code != ACTIONS.index("retry"),
        F.col("attempt").cast("bigint") * len(ACTIONS) + code,
    )
    return (
        attempts.select(
            *ATTEMPT, "exit_code", "stage_error", _action_code(max_attempts).alias("code")
        )
        .groupBy("run_id")
        .agg(
            F.min(rank).alias("rank"),
            F.min_by("exit_code", rank).alias("exit_code"),
            F.min_by(F.col("stage_error") == STREAM, rank).alias("cut_off"),
            F.max("attempt").alias("latest"),
        )
        .select(
            "run_id",
            F.expr(f"CAST(rank div {len(ACTIONS)} AS INT)").alias("attempt"),
            _action_name((F.col("rank") % len(ACTIONS)).cast("int")).alias("action"),
            "exit_code",
            F.when(F.col("cut_off"), STREAM).alias("stage_error"),
            "latest",
        )
    )


def run_outcome(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """How each run ended and at which attempt.

    A run that never came to an end is ``incomplete``; ``attempts_used`` then counts
    up to its latest attempt.
    """
    return _final_attempts(attempts, max_attempts).select(
        "run_id",
        F.coalesce("action", F.lit("incomplete")).alias("outcome"),
        "attempt",
        F.coalesce("attempt", "latest").alias("attempts_used"),
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Runs by outcome, their share, and the mean number of attempts.

    The window runs over one row per outcome, of which there are a fixed few.
    """
    return (
        outcomes.groupBy("outcome")
        .agg(
            F.count("*").alias("runs"),
            F.avg("attempts_used").alias("mean_attempts"),
        )
        .select(
            "outcome",
            "runs",
            (F.col("runs") / F.sum("runs").over(Window.partitionBy())).alias("share"),
            "mean_attempts",
        )
    )


def failure_report(
    attempts: DataFrame,
    logs: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    part_lines: int = PART_LINES,
) -> DataFrame:
    """What is shown for each failed run: the output of its final attempt.

    Only the lines of those attempts are put together. Runs that never came to an end
    have no final attempt and are not in the report; ``run_outcome`` has them as
    ``incomplete``.
    """
    failed = _final_attempts(attempts, max_attempts).filter(
        F.col("action") != "success"
    )
    not_run = F.col("action").isin("analysis_error", "save_error")
    note = (
        F.when(~F.col("is_last"), "")
        .when(F.col("action") == "same_code", SAME_CODE_NOTE)
        .when(F.col("action") == "no_suggestion", NO_SUGGESTION_NOTE)
        .otherwise("")
    )
    cut_off = F.col("is_last") & (F.col("stage_error") == STREAM)
    report = F.when(not_run, fill(STAGE_ERROR_NOTE, "action")).otherwise(
        F.concat("output", F.when(cut_off, STREAM_ERROR_NOTE).otherwise(""), note)
    )
    ran = failed.filter(~not_run).select(*ATTEMPT)
    return with_output(failed.drop("latest"), logs, part_lines, ran).select(
        "run_id",
        F.col("action").alias("outcome"),
        "attempt",
        "part",
        report.alias("report"),
    )


_HUNKS = (
    T.StructType()
    .add("minimal", T.BooleanType())
    .add(
        "hunks",
        T.ArrayType(
            T.StructType()
            .add("at_line", T.LongType())
            .add("n_removed", T.LongType())
            .add("added", T.ArrayType(T.StringType()))
        ),
    )
)


@F.pandas_udf(_HUNKS)
def _hunks(code: pd.Series, suggestion: pd.Series) -> pd.DataFrame:
    rows = []
    for old, new in zip(code, suggestion):
        found, minimal = linediff.hunks(old, new)
        rows.append((minimal, [dict(zip(("at_line", "n_removed", "added"), h)) for h in found]))
    return pd.DataFrame(rows, columns=_HUNKS.names)


def suggestion_diff(attempts: DataFrame) -> DataFrame:
    """What each suggestion changes: a row for each run of changed lines.

    ``hunk`` counts from 1; ``n_removed`` lines of ``code`` from ``at_line`` on, counted
    from 0, give way to the lines ``added``. Applied in order the hunks turn ``code`` into
    ``suggestion``. They are the shortest such change, unless ``minimal`` is false because
    the texts differ in very many lines. A missing code is empty; attempts without a
    suggestion, or with one that is equal, have no rows.
    """
    code, suggestion = F.coalesce("code", F.lit("")), F.col("suggestion")
    changed = attempts.filter(suggestion.isNotNull() & (suggestion != code))
    diff = _hunks.asNondeterministic()(code, suggestion)
    changed = changed.select(*ATTEMPT, diff.alias("diff"))
    return changed.select(
        *ATTEMPT, "diff.minimal", F.posexplode("diff.hunks").alias("pos", "h")
    ).select(
        *ATTEMPT,
        (F.col("pos") + 1).alias("hunk"),
        "h.at_line",
        "h.n_removed",
        F.size("h.added").cast("bigint").alias("n_added"),
        F.array_join("h.added", "\n").alias("added"),
        "minimal",
    )
