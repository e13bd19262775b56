"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have an edge to a smaller component id.

    `edges` has columns a and b.  The component is the least node; nodes that are not in the
    result are components of their own name.  Alternates large-star and small-star steps until
    each node points to the least of its component.  A step joins with only those nodes that
    still have something to pass on, so the hub of a finished star is never gathered anywhere;
    minima are pre-aggregated before their shuffle.
    """
    up, down = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = written(edges.where("a <> b").select(up, down).distinct(), "edges")
    while True:
        # Large star: what points to v points to the least neighbour of v.
        least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        below = edges.select("v").distinct().join(least, "v")
        below = written(below, "large-star")
        moved = not below.isEmpty()
        if moved:
            edges = written(edges.join(below, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "edges")
        # Small star: all smaller neighbours of u point to the least of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")).where("m < most").select("u", "m")
        many = written(least, "small-star")
        if many.isEmpty():
            if not moved:
                return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            continue
        joined = edges.join(many, "u", "left")
        pairs = F.when(F.col("m").isNull(), F.array(F.struct("u", "v"))).otherwise(
            F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        )
        edges = written(joined.select(F.inline(pairs)).where("u <> v").distinct(), "edges")


#: A component is large when it holds more than one of so many parts of all rows, so fewer than that many are.
PARTS = 1_024


def named_by_component(classes: DataFrame) -> DataFrame:
    """`classes` (a written table with `least` and its component `c`) with component_id, the least `least` of its component.

    Large components get it from a broadcast table of fewer than PARTS rows, so none is gathered in one task.
    """
    named = written(classes.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("rows")), "named")
    bound = classes.count() // PARTS
    large = F.broadcast(named.where(F.col("rows") > bound).select("c", "component_id"))
    small = named.where(F.col("rows") <= bound).select("c", "component_id")
    rest = classes.join(large.select("c"), "c", "left_anti").join(small, "c")
    return classes.join(large, "c").unionByName(rest)
