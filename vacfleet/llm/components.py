"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacfleet.llm.common import join_by_key
from vacfleet.session import store


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """Link neighbours to the smallest node of their neighbourhood.

    Large: each node's larger neighbours go to the smallest of the neighbourhood. Small: a
    node and its smaller neighbours do.
    """
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        out = join_by_key(sides, least, "a", "n", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        out = (join_by_key(down, least, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select("a", F.col("m").alias("b"))))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, component`` (its smallest reachable node) for every node of ``a, b`` edges.

    Each round is stored in the shared checkpoint folder, so a lost executor costs one round;
    the driver sees one row of sums a round. Self loops and null ends are left out.
    """
    now = store(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
                .where("a <> b").distinct(), f"{name}_edges")
    mark = None
    while True:
        # sums of 31-bit hashes: no id overflows them
        sums = now.agg(F.count("*"), *(F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(k), "a", "b"), 33)) for k in (1, 2))).first()
        if sums == mark or not sums[0]:
            break
        mark = sums
        # a table each: both stars read their edges twice
        wide = store(_star(now, sums[0], large=True), f"{name}_large")
        now = store(_star(wide, sums[0], large=False), f"{name}_small")
    pairs = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
