"""The registered queries: every operator over the whole of its input tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths
from ..operators import attempts, correction, etl, failures, lineage, runlog, scripts, statistics
from ..operators.sizing import spread
from ..sources import raw_lines, rows, workspace
from ..sources.storage import fresh_dir, stage
from ..streaming import logs as streaming, outputs, verdicts, windows
from . import fixtures as fx
from .etl import report_of_years, run_etl, stage_years

YEAR = 1995
BASE = "/work/base"

# Numbers of ``seq`` of a part, so few that most outputs have several.
SMALL_PARTS = 2_000

Query = Callable[[SparkSession, str], DataFrame]


def _over(*blocks: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """A query over the tables that the blocks derive."""

    def wrap(build: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: build(
            *(fx.load(spark, sf_dir, block) for block in blocks)
        )

    return wrap


def _scripts(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(spread(fx.load(spark, sf_dir, fx.SCRIPTS)))


def _log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as they arrive, as log lines."""
    return spark.sql(
        fx.LOG_LINES, events=streaming.file_stream(spark, f"{sf_dir}/events.parquet")
    )


def _attempt_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts as they arrive, all started when the log begins."""
    orders = streaming.file_stream(spark, f"{sf_dir}/orders.parquet")
    started = F.lit("2024-01-01").cast("timestamp_ntz")
    return spark.sql(fx.ATTEMPTS, orders=orders).withColumn("started", started)


def _attempt_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt prints a line; those with an exit code report it a minute later."""
    event = lambda kind, code, minutes: F.struct(
        F.lit(kind).alias("kind"),
        code.cast("int").alias("exit_code"),
        (F.col("started") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("ts"),
    )
    events = F.array(event("line", F.lit(None), 0), event("status", F.col("exit_code"), 1))
    tries = _attempt_stream(spark, sf_dir).select("run_id", "attempt", F.inline(events))
    tries = tries.filter("kind = 'line' OR exit_code IS NOT NULL")
    return verdicts.attempt_closed(tries, upto="2024-03-01")


def _live_output_or_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.live_output_or_note(
        _attempt_stream(spark, sf_dir),
        _log_stream(spark, sf_dir),
        span="40 days",
        upto="2024-06-01",
        part_lines=SMALL_PARTS,
    )


def _raw_lines(df: DataFrame) -> DataFrame:
    """The lines written to a text file for each attempt and stream, and read again."""
    root = fresh_dir(df.sparkSession, "raw_lines")
    keys = ["run_id", "attempt", "stream"]
    files = df.repartition(*keys).sortWithinPartitions(*keys, "seq")
    files.select(*keys, F.col("line").alias("value")).write.partitionBy(*keys).text(root)
    return raw_lines.read_raw_lines(df.sparkSession, root)


def _workspace(df: DataFrame) -> workspace.Workspace:
    # Not closed here: the caller has yet to read what was written.
    return workspace.Workspace.fresh(df.sparkSession)


def _balanced(prompt: str) -> str:
    """A pure stand-in for a corrector: closes the parenthesis left open."""
    code = prompt.split(correction.CODE_HEAD)[1].split(correction.OUTPUT_HEAD)[0]
    return f"```python\n{code})\n```"


def _broken(df: DataFrame) -> DataFrame:
    return scripts.with_syntax(df).filter(~F.col("ok")).select(
        "script_id",
        "code",
        F.concat_ws(": ", "error_type", "message").alias("output"),
    )


def _correct_syntax(df: DataFrame) -> DataFrame:
    return correction.map_corrector(_broken(df), _balanced).select("script_id", "suggestion")


def _ask_once(df: DataFrame) -> DataFrame:
    store = correction.ReplyStore(fresh_dir(df.sparkSession, "replies"))
    prompt = correction.prompt_text(F.col("code"), F.col("output"))
    prompts = _broken(df).select("script_id", prompt.alias("prompt"))
    return store.ask(prompts, _balanced).select("script_id", "suggestion")


def _etl_years(df: DataFrame) -> DataFrame:
    """All years staged under one label, then one of them under another."""
    place = _workspace(df)
    stage_years(place, df, "Sistema_A")
    stage_years(place, etl.filter_year(df, YEAR))
    return report_of_years(place, YEAR, YEAR + 1)


def _run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders = orders.withColumn("day", F.col("o_orderdate").cast("date"))
    kept = stage(statistics.sketches(orders, "day", "o_custkey", "o_totalprice"), "run_statistics")
    month = F.trunc("day", "month").alias("month")
    return statistics.report(kept, month)


def _calls(df: DataFrame) -> DataFrame:
    return scripts.script_paths(df, BASE)


def _script_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = spread(fx.load(spark, sf_dir, fx.LINKED_SCRIPTS))
    calls = _calls(code).withColumnRenamed("original_path", "path")
    return lineage.script_order(code, calls)


def queries() -> dict[str, Query]:
    tx = _over(fx.TRANSACTIONS)
    script = _scripts
    log = _over(fx.LOG_LINES)
    tries = _over(fx.ATTEMPTS)
    tries_log = _over(fx.ATTEMPTS, fx.LOG_LINES)
    return {
        # ETL
        "rows_typed": _over(fx.UNTYPED_ROWS)(
            lambda df: rows.typed(df, rows.TRANSACTION_SCHEMA)
        ),
        "rows_inferred": _over(fx.PEOPLE)(
            lambda df: rows.inferred(df, ["id", "name", "age"])
        ),
        "parquet_scan": lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet"),
        "parquet_roundtrip": tx(
            lambda df: _workspace(df).stage(df, "nested/dir/transactions.parquet")
        ),
        "date_parts": tx(etl.date_parts),
        "upper_name": tx(etl.upper_name),
        "constant_column": tx(etl.constant_column),
        "project_reorder": tx(etl.enrich),
        "project_rename": tx(lambda df: df.transform(etl.enrich).transform(etl.finalize)),
        "filter_year": tx(lambda df: df.transform(etl.filter_year, YEAR)),
        "filter_ge": _over(fx.PEOPLE)(lambda df: etl.filter_ge(df, "age", 18)),
        "row_count": tx(etl.row_count),
        "preview": tx(lambda df: etl.preview(df, "id_registro", 5)),
        "schema_report": tx(etl.schema_report),
        "etl_flow": tx(lambda df: run_etl(_workspace(df), df, YEAR)),
        "etl_years": tx(_etl_years),
        # Run-scoped storage
        "run_ids": lambda spark, sf_dir: workspace.run_ids(
            spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey"
        ),
        "resolve_paths": _over(fx.PATHS)(
            lambda df: df.select(
                "path_id",
                "path",
                paths.resolve(F.col("path"), F.lit(BASE)).alias("resolved_path"),
                paths.escapes(F.col("path"), F.lit(BASE)).alias("escapes"),
            )
        ),
        "workspace_roundtrip": tx(
            lambda df: _workspace(df).stage(df, workspace.DEFAULT_INPUT)
        ),
        "default_input": _over(fx.INPUT_ROWS)(
            lambda df: workspace.prepare_input(
                _workspace(df), rows.typed(df, rows.INPUT_SCHEMA)
            )
        ),
        # Scripts
        "script_syntax": script(scripts.script_syntax),
        "script_paths": script(_calls),
        "script_inputs": script(scripts.script_inputs),
        "script_rewrite": script(lambda df: scripts.script_rewrite(df, BASE)),
        "script_inferred_paths": lambda spark, sf_dir: scripts.script_inferred_paths(
            spread(fx.load(spark, sf_dir, fx.BUILT_PATHS)), BASE
        ),
        "script_order": _script_order,
        "dataset_usage": script(lambda df: scripts.dataset_usage(_calls(df))),
        # Run logs
        "log_display": log(runlog.log_display),
        "log_frames": tries(runlog.log_frames),
        "log_full_output": log(runlog.log_full_output),
        "log_output_parts": log(lambda df: runlog.log_full_output(df, SMALL_PARTS)),
        "log_by_stream": log(lambda df: runlog.log_by_stream(df, SMALL_PARTS)),
        "output_or_note": tries_log(
            lambda df, lines: runlog.output_or_note(df, lines, SMALL_PARTS)
        ),
        "success_marker": log(
            lambda df: runlog.success_marker(df, part_lines=SMALL_PARTS)
        ),
        "error_type": _over(fx.ERROR_LINES)(
            lambda df: runlog.error_type(df, SMALL_PARTS)
        ),
        "failure_kinds": _over(fx.ERROR_LINES)(
            lambda df: failures.failure_kinds(runlog.error_type(df))
        ),
        "attempt_verdict": tries(runlog.attempt_verdict),
        "log_stream_totals": lambda spark, sf_dir: streaming.log_stream_totals(
            _log_stream(spark, sf_dir)
        ),
        "log_stream_output": lambda spark, sf_dir: streaming.log_stream_output(
            _log_stream(spark, sf_dir)
        ),
        # Live, by event time
        "log_window_totals": lambda spark, sf_dir: windows.log_window_totals(
            _log_stream(spark, sf_dir)
        ),
        "attempt_closed": _attempt_closed,
        "live_output_or_note": _live_output_or_note,
        "raw_lines": _over(fx.RAW_LINES)(_raw_lines),
        # Attempts and outcomes
        "suggestion_changed": tries(attempts.suggestion_changed),
        "suggestion_diff": _over(fx.EDITS)(attempts.suggestion_diff),
        "run_statistics": _run_statistics,
        "attempt_action": tries(attempts.attempt_action),
        "run_outcome": tries(attempts.run_outcome),
        "run_summary": tries(lambda df: attempts.run_summary(attempts.run_outcome(df))),
        "failure_report": tries_log(
            lambda df, lines: attempts.failure_report(df, lines, part_lines=SMALL_PARTS)
        ),
        # Corrections
        "prompt_text": tries_log(
            lambda df, lines: correction.prompts(df, lines, part_lines=SMALL_PARTS)
        ),
        "clean_response": _over(fx.RESPONSES)(correction.clean_responses),
        "map_corrector": script(_correct_syntax),
        "ask_once": script(_ask_once),
    }
