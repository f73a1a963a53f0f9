"""Jobs over tables of Python scripts, ``(script_id, code)``.

Only ``code`` and the base path go to Python, in Arrow batches; every other
column stays in the JVM. Scripts are parsed and never run.
"""

import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import paths, pyscript

# Types as objects: a DDL text could only be read with a session at hand.
_CALL = (
    T.StructType()
    .add("call_no", T.IntegerType())
    .add("original_path", T.StringType())
    .add("direction", T.StringType())
    .add("inferred_path", T.StringType())
)
_ANALYSIS = (
    T.StructType()
    .add("ok", T.BooleanType())
    .add("error_type", T.StringType())
    .add("line", T.IntegerType())
    .add("message", T.StringType())
    .add("calls", T.ArrayType(_CALL))
    .add("rewritten_code", T.StringType())
    .add("stage_error", T.StringType())
)


def _calls_of(tree) -> list[dict]:
    found = []
    calls = list(pyscript.parquet_calls(tree))
    literals = [pyscript.path_literal(call) for call in calls]
    inferred = {} if None not in literals else pyscript.inferred_paths(tree)
    for number, (call, literal) in enumerate(zip(calls, literals), 1):
        found.append(
            {
                "call_no": number,
                "original_path": None if literal is None else literal.value,
                "direction": pyscript.direction(call),
                "inferred_path": inferred.get(call) if literal is None else literal.value,
            }
        )
    return found


def _analysis_of(code: str | None, base: str):
    if code is None:
        return None, None, None, None, [], None, None
    tree, error = pyscript.parse(code)
    syntax = (True, None, None, None)
    if error is not None:
        message = getattr(error, "msg", str(error))
        syntax = (False, type(error).__name__, getattr(error, "lineno", None), message)
    calls = [] if tree is None else _calls_of(tree)
    return *syntax, calls, *pyscript.rewrite(code, tree, error, base)


@F.pandas_udf(_ANALYSIS)
def _analyse(code: pd.Series, base: pd.Series) -> pd.DataFrame:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows = [_analysis_of(text, under) for text, under in zip(code, base)]
    return pd.DataFrame(rows, columns=_ANALYSIS.names, dtype="object")


def _as_column(base: str | Column) -> Column:
    return base if isinstance(base, Column) else F.lit(base)


def _analysed(scripts: DataFrame, base: str | Column = "/") -> DataFrame:
    """The scripts with ``_base`` and ``_result``, all that one parse tells."""
    # Parsed once per row, whatever the optimizer does with what is read from it.
    parsed = _analyse.asNondeterministic()("code", "_base")
    return scripts.withColumn("_base", _as_column(base)).withColumn("_result", parsed)


def with_syntax(scripts: DataFrame) -> DataFrame:
    """The scripts with ``ok``, whether they parse, and if not ``error_type``,
    ``line`` and ``message``."""
    told = [f"_result.{c}" for c in ("ok", "error_type", "line", "message")]
    return _analysed(scripts).select(*scripts.columns, *told)


def script_syntax(scripts: DataFrame) -> DataFrame:
    """Whether each script parses, and if not the error with its line."""
    return with_syntax(scripts.select("script_id", "code")).drop("code")


def script_paths(scripts: DataFrame, base: str | Column) -> DataFrame:
    """One row per ``.parquet(...)`` call, in source order.

    ``dynamic`` marks calls whose path is not a literal. ``escapes`` marks paths
    that leave ``base``; a script with such a path must not be run.
    """
    path, under = F.col("call.original_path"), F.col("_base")
    return (
        _analysed(scripts, base)
        .select("script_id", "_base", F.explode("_result.calls").alias("call"))
        .select(
            "script_id",
            "call.call_no",
            "call.original_path",
            paths.resolve(path, under).alias("resolved_path"),
            "call.direction",
            path.isNull().alias("dynamic"),
            paths.escapes(path, under).alias("escapes"),
        )
    )


def script_inferred_paths(scripts: DataFrame, base: str | Column) -> DataFrame:
    """One row per ``.parquet(...)`` call with ``inferred_path``: its literal, or the one
    text that the names, sums and f-strings of the argument can have there. NULL if two
    texts can reach the call, or if the argument is not understood."""
    path, under = F.col("call.inferred_path"), F.col("_base")
    return (
        _analysed(scripts, base)
        .select("script_id", "_base", F.explode("_result.calls").alias("call"))
        .select(
            "script_id",
            "call.call_no",
            "call.inferred_path",
            paths.resolve(path, under).alias("resolved_path"),
            "call.direction",
            F.col("call.original_path").isNull().alias("dynamic"),
            paths.escapes(path, under).alias("escapes"),
        )
    )


def script_inputs(scripts: DataFrame) -> DataFrame:
    """Relative paths each script reads, and how often; counted within its row."""
    read = F.filter(
        "_result.calls",
        lambda c: (c["direction"] == "read") & paths.is_relative(c["original_path"]),
    )
    read = F.transform(read, lambda c: c["original_path"])

    def counted(path: Column) -> Column:
        n = F.size(F.filter("read", lambda p: p == path)).cast("bigint")
        return F.struct(path.alias("original_path"), n.alias("n"))

    return (
        _analysed(scripts)
        .select("script_id", read.alias("read"))
        .select("script_id", F.inline(F.transform(F.array_distinct("read"), counted)))
    )


def dataset_usage(calls: DataFrame) -> DataFrame:
    """How often each literal path is read and written over all scripts."""
    return (
        calls.filter(~F.col("dynamic"))
        .groupBy("original_path", "direction")
        .agg(F.count("*").alias("n"))
    )


def script_rewrite(scripts: DataFrame, base: str | Column) -> DataFrame:
    """Each script with its relative Parquet paths put under ``base``.

    ``code`` is kept, since a correction is asked for the code as it was given.
    ``stage_error`` is set where the script could not be analysed at all. A script
    with ``escapes`` has a path that leaves ``base`` and must not be run.
    """
    leaves = F.exists("_result.calls", lambda c: paths.escapes(c["original_path"], F.col("_base")))
    return _analysed(scripts, base).select(
        "script_id", "code", "_result.rewritten_code", "_result.stage_error", leaves.alias("escapes")
    )
