"""Texts that go to and come from whoever corrects a failed script."""

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import WHITE_SPACE, strip_ws
from ..sources.storage import exists
from .attempts import MAX_ATTEMPTS
from .runlog import (
    ATTEMPT,
    PART_LINES,
    STREAM,
    STREAM_ERROR_NOTE,
    exit_code,
    with_output,
)

EMPTY_OUTPUT_NOTE = (
    "[note] the script failed and printed nothing; look for the cause in the code"
)
NO_CODE_NOTE = "[note] the code is not known"
INSTRUCTION = (
    "The PySpark script below failed. Its output follows the code.\n"
    "Correct syntax and run-time errors. Reply with the whole corrected script, as\n"
    "Python code only: no explanation and no code fence.\n\n"
)
CODE_HEAD = "--- CODE ---\n"
OUTPUT_HEAD = "\n\n--- OUTPUT ---\n"
END = "\n\n--- CORRECTED CODE ---\n"

_OPENING_FENCE = rf"^(?:```python|```)[{WHITE_SPACE}]*+"
_CLOSING_FENCE = r"```\z"


def _head(code: Column) -> Column:
    code = F.coalesce(code, F.lit(NO_CODE_NOTE))
    return F.concat(F.lit(INSTRUCTION + CODE_HEAD), code, F.lit(OUTPUT_HEAD))


def prompt_text(code: Column, output: Column) -> Column:
    """The prompt for a failed script."""
    shown = F.coalesce(F.nullif(strip_ws(output), F.lit("")), F.lit(EMPTY_OUTPUT_NOTE))
    return F.concat(_head(code), shown, F.lit(END))


def prompt_part(
    code: Column, output: Column, is_first: Column, is_last: Column
) -> Column:
    """The prompt for a part of an output: the first part carries the code."""
    whole = is_first & is_last
    return F.when(whole, prompt_text(code, output)).otherwise(
        F.concat(
            F.when(is_first, _head(code)).otherwise(""),
            output,
            F.when(is_last, F.lit(END)).otherwise(""),
        )
    )


def prompts(
    attempts: DataFrame,
    logs: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    part_lines: int = PART_LINES,
) -> DataFrame:
    """The prompt of every attempt that ran, failed, and may be tried again; one of
    which the output broke off has failed."""
    cut_off = F.coalesce(F.col("stage_error") == STREAM, F.lit(False))
    asked = attempts.filter(
        (cut_off | F.col("stage_error").isNull() & (exit_code() != 0))
        & (F.col("attempt") < max_attempts)
    )
    note = F.when(cut_off & F.col("is_last"), STREAM_ERROR_NOTE).otherwise("")
    output = F.concat("output", note)
    prompt = prompt_part(F.col("code"), output, F.col("is_first"), F.col("is_last"))
    return with_output(
        asked.select(*ATTEMPT, "exit_code", "code", "stage_error"),
        logs,
        part_lines,
        asked.select(*ATTEMPT),
    ).select(*ATTEMPT, "part", prompt.alias("prompt"))


def clean_response(raw: Column) -> Column:
    """The code in a reply, without the fence around it; NULL if there is none.

    A fence that opens the reply goes, with its ``python`` tag, then one that
    closes it, and white space around each. Other tags and text before the fence
    stay.
    """
    opened = F.regexp_replace(strip_ws(raw), _OPENING_FENCE, "")
    code = strip_ws(F.regexp_replace(opened, _CLOSING_FENCE, ""))
    return F.nullif(code, F.lit(""))


def clean_responses(replies: DataFrame) -> DataFrame:
    return replies.select("conv_id", "turn", clean_response(F.col("raw")).alias("code"))


def _replies(correct: Callable[[str], str | None]):
    """A column function that asks ``correct`` for every prompt; NULL where it fails."""

    def ask(prompt):
        try:
            reply = correct(prompt)
        except Exception:
            return None
        return reply if isinstance(reply, str) else None

    @F.pandas_udf("string")
    def replies(prompt: pd.Series) -> pd.Series:
        return prompt.map(ask).astype("object")

    return replies


def map_corrector(
    scripts: DataFrame, correct: Callable[[str], str | None], code="code", output="output"
) -> DataFrame:
    """Ask ``correct`` for every row; adds ``suggestion``, NULL where it fails.

    ``correct`` takes a prompt and returns a reply. It runs inside tasks, must be
    picklable, and is asked again for a batch whose task is retried. Spread rows
    over more tasks with ``repartition`` before the call when it is slow.
    """

    # Asked once per row, whatever the optimizer does with the expressions above.
    prompt = prompt_text(F.col(code), F.col(output))
    reply = _replies(correct).asNondeterministic()(prompt)
    return (
        scripts.withColumn("reply", reply)
        .withColumn("suggestion", clean_response(F.col("reply")))
        .drop("reply")
    )


@dataclass(frozen=True)
class ReplyStore:
    """Replies by prompt, kept at ``path``, so that no prompt is asked twice.

    A prompt is known by its SHA-256. ``ask`` asks the distinct prompts that are not in the
    store, a share of them at a time, and appends each share before the next; so what was
    answered before a failure is not asked again. Failed replies are kept as NULL and not
    asked again either; ``retry`` asks those anew. One caller at a time.
    """

    path: str
    shares: int = 4

    _SCHEMA = "digest string, asked int, reply string"

    def replies(self, spark: SparkSession) -> DataFrame:
        """``digest, reply``, of each prompt the latest."""
        if not exists(spark, self.path):
            return spark.createDataFrame([], "digest string, reply string")
        rows = spark.read.schema(self._SCHEMA).parquet(self.path)
        latest = F.max_by(F.struct("reply"), F.struct("asked", F.col("reply").isNotNull()))
        return rows.groupBy("digest").agg(latest.alias("r")).select("digest", "r.reply")

    def ask(
        self, prompts: DataFrame, correct: Callable[[str], str | None], retry: bool = False
    ) -> DataFrame:
        """``prompts``, which has ``prompt``, with ``suggestion``: the cleaned reply."""
        spark = prompts.sparkSession
        digest = F.sha2(F.col("prompt").cast("binary"), 256)
        asked = prompts.filter("prompt IS NOT NULL").select(digest.alias("digest"), "prompt")
        for share in range(self.shares):
            # Within a share the store does not change while it is read.
            known = self.replies(spark)
            known = known.filter("reply IS NOT NULL") if retry else known
            rest = asked.filter(F.pmod(F.xxhash64("digest"), F.lit(self.shares)) == share)
            rest = rest.join(known, "digest", "left_anti")
            # Distinct by digest, since texts are long; equal digests have equal prompts.
            rest = rest.groupBy("digest").agg(F.any_value("prompt").alias("prompt"))
            reply = _replies(correct).asNondeterministic()("prompt")
            number = F.lit(1 if retry else 0)
            rest.select("digest", number.alias("asked"), reply.alias("reply")).write.mode(
                "append"
            ).parquet(self.path)
        replies = self.replies(spark).withColumnsRenamed({"digest": "_digest", "reply": "_reply"})
        joined = prompts.join(replies, digest == F.col("_digest"), "left")
        return joined.select(*prompts.columns, clean_response(F.col("_reply")).alias("suggestion"))
