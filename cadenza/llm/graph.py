"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common

JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(v, component)``: the smallest vertex that each vertex reaches.

    Every vertex points to the least of itself and its neighbours; following the
    pointers a few steps gives partial components, the graph is contracted to
    them, and so on until no edge is left. The least vertex of a component points
    to itself in every round, so it is what all end at. The least neighbour is a
    partial aggregate and everything else an equi-join that Spark can split, so a
    vertex with millions of edges is no single task's work. Rounds are written to
    the shared folder, so Spark knows their true sizes when it picks a join: only
    what is under its broadcast threshold is broadcast. No edges give no rows.
    """
    pairs = edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    now = common.stored(pairs.union(pairs.select("v", "u")).distinct())
    found = None
    while not now.isEmpty():
        to = common.stored(now.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        for _ in range(JUMPS):
            step = to.select(F.col("u").alias("m"), F.col("m").alias("next"))
            to = to.join(step, "m").select("u", F.col("next").alias("m"))
        to = common.stored(to)
        left, right = to.select("u", F.col("m").alias("x")), to.select(F.col("u").alias("v"), F.col("m").alias("y"))
        now = common.stored(now.join(left, "u").join(right, "v").filter("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
        found = to if found is None else common.stored(follow(found, to))
    if found is None:
        return pairs.select(F.col("u").alias("v"), F.col("v").alias("component"))
    return found.select(F.col("u").alias("v"), F.col("m").alias("component"))


def follow(first: DataFrame, then: DataFrame) -> DataFrame:
    """(u, m) of two maps in a row; what the second does not move stays."""
    step = then.select(F.col("u").alias("m"), F.col("m").alias("next"))
    return first.join(step, "m", "left").select("u", F.coalesce("next", "m").alias("m"))
