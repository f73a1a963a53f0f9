"""The order in which scripts can run, from the paths they read and write.

A script depends on every other script that writes a path it reads. Dependencies are never
written out as pairs: a path that many scripts write and many read has as many rows as it
has readers and writers. Rounds take away the scripts that depend on none of the rest, so
there are as many rounds as the longest chain has scripts, and what is left when a round
takes nothing are the cycles and what comes after them.

What a round keeps is written to the scratch folder, so a lost executor costs one round.
"""

from pyspark.sql import DataFrame, functions as F

from ..sources.storage import stage

_ROLES = ("read", "write")


def _remaining(uses: DataFrame, given: str, taken: str) -> DataFrame:
    """Of ``script_id, path, direction`` the rows of the scripts that must wait: another one
    has a path as ``given`` that they have as ``taken``."""
    # The least and the greatest id tell whether a path has another script than a given one.
    others = (
        uses.filter(F.col("direction") == given)
        .groupBy("path")
        .agg(F.min("script_id").alias("low"), F.max("script_id").alias("high"))
    )
    waiting = (
        uses.filter(F.col("direction") == taken)
        .join(others, "path")
        .filter("low <> script_id OR high <> script_id")
        .select("script_id")
    )
    return uses.join(waiting, "script_id", "left_semi")


def _peeled(uses: DataFrame, given: str, taken: str) -> tuple[list[DataFrame], DataFrame]:
    """The rows left after each round that took some scripts, and those left in the end."""
    rounds, n = [], uses.count()
    while n:
        uses = stage(_remaining(uses, given, taken), "script_round")
        left = uses.count()
        if left == n:
            break
        rounds.append(uses)
        n = left
    return rounds, uses


def script_order(scripts: DataFrame, calls: DataFrame) -> DataFrame:
    """``script_id, level, on_cycle, n_unwritten`` of every script.

    ``calls`` has ``script_id, path, direction``. A script of ``level`` k waits for a chain
    of k others; scripts of one level can run together. ``level`` is NULL for a script that
    waits for itself by way of others, or for such a script; ``on_cycle`` holds for those on
    a cycle or between two. ``n_unwritten`` counts the paths it reads that no script writes.
    A script that reads what it writes itself does not wait for that. Calls without a path or
    a direction do not count.
    """
    uses = calls.filter(F.col("path").isNotNull() & F.col("direction").isin(*_ROLES))
    uses = stage(uses.select("script_id", "path", "direction").distinct(), "script_uses")
    ends = uses.groupBy("path").agg(F.count_distinct("direction").alias("n_roles"))
    inner = stage(
        uses.join(ends.filter("n_roles = 2"), "path", "left_semi").select("script_id", "path", "direction"),
        "script_inner_uses",
    )
    unwritten = (
        uses.filter("direction = 'read'")
        .join(ends.filter("n_roles = 1"), "path", "left_semi")
        .groupBy("script_id")
        .agg(F.count("*").alias("n_unwritten"))
    )
    rounds, stuck = _peeled(inner, "write", "read")
    _, core = _peeled(stuck, "read", "write")

    ids = scripts.select("script_id").distinct()
    # A script's level is the number of rounds that it stayed.
    stayed = inner.select("script_id").limit(0)
    for left in rounds:
        stayed = stayed.unionByName(left.select("script_id").distinct())
    levels = stayed.groupBy("script_id").agg(F.count("*").alias("level"))
    flag = lambda df, name: df.select("script_id").distinct().withColumn(name, F.lit(True))
    return (
        ids.join(levels, "script_id", "left")
        .join(unwritten, "script_id", "left")
        .join(flag(stuck, "stuck"), "script_id", "left")
        .join(flag(core, "core"), "script_id", "left")
        .select(
            "script_id",
            F.when(F.col("stuck").isNull(), F.coalesce("level", F.lit(0))).alias("level"),
            F.col("core").isNotNull().alias("on_cycle"),
            F.coalesce("n_unwritten", F.lit(0)).alias("n_unwritten"),
        )
    )
