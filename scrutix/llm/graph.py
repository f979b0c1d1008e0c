"""Connected components of a link table, distributed at every step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(links: DataFrame, name: str = "cc") -> DataFrame:
    """``(node, component)`` for every end of ``links`` (columns ``a``, ``b``, longs).

    Each round hooks a node to its smallest smaller neighbour (a partial
    aggregate, so a hub's links never meet in one task), shortens the paths by
    two joins and contracts the links.  Rounds are written as tables in the
    shared folder, so a lost executor costs running tasks only.  A star takes
    one round and a path of n nodes O(log n) rounds in practice.
    """
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    cur = materialize(links.select(lo, hi).filter("lo < hi").distinct(), f"{name}-links")
    labels = None
    while not cur.isEmpty():
        old = [cur] if labels is None else [cur, labels]
        hook = materialize(cur.groupBy("hi").agg(F.min("lo").alias("up")), f"{name}-hook")

        def through(df: DataFrame, column: str, hook: DataFrame = hook) -> DataFrame:
            """``column`` replaced by where it is hooked, if it is."""
            to = hook.select(F.col("hi").alias("_n"), F.col("up").alias("_u"))
            return df.join(to, F.col(column) == F.col("_n"), "left").withColumn(column, F.coalesce("_u", column)).drop("_n", "_u")

        old.append(hook)
        hook = materialize(through(through(hook, "up"), "up"), f"{name}-jump")
        old.append(hook)
        nodes = cur.select(F.explode(F.array("lo", "hi")).alias("node")).distinct()
        if labels is None:
            labels = nodes.withColumn("component", F.col("node"))
        labels = materialize(through(labels, "component", hook), f"{name}-labels")
        both = through(through(cur, "lo", hook), "hi", hook)
        cur = materialize(both.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).filter("lo < hi").distinct(), f"{name}-links")
        discard(*old)
    if labels is None:
        labels = cur.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return labels
