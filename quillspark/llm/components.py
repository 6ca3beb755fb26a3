"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node on an edge ``a, b`` (long): root is the component's smallest node.

    Alternates large-star and small-star steps: each node's larger (then smaller) neighbours are
    re-attached to its least neighbour, until nothing changes. No neighbour list is gathered; each
    step aggregates a minimum and joins it back, and each round is written to the shared folder.
    An edge may be repeated or point both ways; self-loops are ignored; no edges give no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "round0")
    state = _state(now)
    for i in range(1, rounds + 1):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        attached = large.join(least, "a")
        small = attached.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = scratch.keep(small.select("e.a", "e.b").filter("a <> b").distinct(), f"round{i}")
        scratch.drop(f"round{i - 1}")
        now, before, state = new, state, _state(new)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    # A settled graph is a forest of stars: every node points at its root.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
