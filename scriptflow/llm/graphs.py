"""Connected components of a large graph, and joins with a side of checked size."""

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.storage import stage

#: Bytes of a join side that may be sent to every executor.
BROADCAST_BYTES = 48_000_000


def limited(side: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``side``, staged, and marked for broadcast if its rows take at most
    ``BROADCAST_BYTES`` in all; ``row_bytes`` is the size of a row, or its expression.
    Otherwise the join shuffles, with the same result."""
    side = stage(side, "join_side")
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    total = side.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(side) if total <= BROADCAST_BYTES else side


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b`` (long, not null).

    Each round hooks every node to the neighbour that comes first in a random order
    of the round, and goes on with the graph of these neighbours, of which there are
    fewer by a constant factor. A component is named after one of its nodes.
    """
    edges = stage(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    hooks = []
    while not edges.isEmpty():
        order = lambda c: F.struct(  # noqa: E731, B023
            F.xxhash64(F.lit(len(hooks)), c).alias("rank"), F.col(c).alias("node")
        )
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy("a").agg(F.min(order("b")).alias("first"))
        hook = stage(
            hook.select(
                F.col("a").alias("node"), F.least(order("a"), "first").getField("node").alias("to")
            ),
            "hooks",
        )
        hooks.append(hook)
        to = lambda c: hook.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        edges = stage(
            edges.join(to("a"), "a")
            .join(to("b"), "b")
            .filter("a_to <> b_to")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
            .distinct(),
            "edges",
        )
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    named = hooks[-1].select("node", F.col("to").alias("component"))
    for hook in reversed(hooks[:-1]):
        # A neighbour without edges in the later graph is the name of its component.
        later = named.withColumnRenamed("node", "to")
        named = hook.join(later, "to", "left").select(
            "node", F.coalesce("component", "to").alias("component")
        )
    return stage(named, "components")
