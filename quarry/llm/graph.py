"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialize


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, component): the smallest node reachable from each node that has a link.

    Every round hooks each node to its smallest neighbour, follows the hooks
    to their ends (four steps a pass), and contracts the links to those ends.  At least half of
    the nodes that still have links go in a round, and links that fall
    together count once from then on.
    """
    spark = links.sparkSession
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges", small=True)
    labels = None
    while True:
        ends = edges.select(F.col("a").alias("u"), "b").union(edges.select("b", "a"))
        hooks = materialize(ends.groupBy("u").agg(F.least(F.col("u"), F.min("b")).alias("p")), "hooks", small=True)
        while True:
            twice = _follow(hooks, hooks)
            longer = _follow(twice, twice).withColumnRenamed("p", "end").join(hooks.withColumnRenamed("p", "near"), "u")
            longer = materialize(longer.select("u", F.col("end").alias("p"), (F.col("end") != F.col("near")).alias("moved")), "hooks", small=True)
            moved = longer.filter("moved").limit(1).count()
            delete(spark, hooks)
            hooks = longer.drop("moved")
            if not moved:
                break
        if labels is None:
            found = hooks.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            step = hooks.select(F.col("u").alias("component"), "p")
            found = materialize(labels.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels", small=True)
        labels = found
        to_a, to_b = hooks.toDF("a", "pa"), hooks.toDF("b", "pb")
        less = edges.join(to_a, "a").join(to_b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        less = materialize(less, "edges", small=True)
        delete(spark, edges)
        edges = less
        if not edges.limit(1).count():
            return labels


def _follow(first: DataFrame, second: DataFrame) -> DataFrame:
    """(u, p): where the steps of second lead from the ends of first."""
    return first.join(second.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"))
