"""Path rules for run-scoped storage, as columns and for one path.

A relative path belongs under the run's base directory. Absolute paths and paths
with a scheme (``s3a://bucket/x``) are left alone. ``.`` and empty segments are
dropped; ``..`` is kept, and a path that climbs above the base is reported.
"""

import re

from pyspark.sql import Column, functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def _climbs_out(path: Column) -> Column:
    """True if walking the segments ever goes above the starting directory."""

    def step(state, segment):
        depth = state["depth"] + F.when(segment == "..", -1).otherwise(1)
        return F.struct(
            depth.alias("depth"), F.least(state["low"], depth).alias("low")
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))
    return F.aggregate(_segments(path), start, step, lambda s: s["low"] < 0)


def is_relative(path: Column) -> Column:
    return ~(path.startswith("/") | path.rlike(_SCHEME))


def resolve(path: Column, base: Column) -> Column:
    """The path under ``base`` if relative, else unchanged."""
    tail = F.array_join(_segments(path), "/")
    under_base = F.when(tail == "", base).otherwise(F.concat(base, F.lit("/"), tail))
    return F.when(is_relative(path), under_base).otherwise(path)


def escapes(path: Column, base: Column) -> Column:
    """True if a path that is meant to lie under ``base`` leaves it through ``..``."""
    prefix = F.concat(base, F.lit("/"))
    below = F.when(is_relative(path), path).when(
        path.startswith(prefix), F.substr(path, F.length(prefix) + 1)
    )
    return F.coalesce(_climbs_out(below), F.lit(False))


def resolve_one(path: str, base: str) -> str:
    """``resolve`` for one path on the driver or inside a task."""
    if path.startswith("/") or re.match(_SCHEME, path):
        return path
    tail = "/".join(s for s in path.split("/") if s not in ("", "."))
    return f"{base}/{tail}" if tail else base


def escapes_one(path: str, base: str) -> bool:
    """``escapes`` for one path."""
    if path.startswith(base + "/"):
        path = path[len(base) + 1 :]
    elif path.startswith("/") or re.match(_SCHEME, path):
        return False
    depth = 0
    for segment in path.split("/"):
        if segment in ("", "."):
            continue
        depth += -1 if segment == ".." else 1
        if depth < 0:
            return True
    return False
