"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a partial aggregate plus an equi-join (a hub's edges are split by
AQE's skew join), and each round is cut by a reliable checkpoint.  Edges never
leave the executors; only a count and a checksum of each round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styleframe.session import checkpoint


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) bigint edges -> (node, root): each node but the smallest of its component,
    with the smallest.  Nodes without a row are their own root.  Self-loops and null
    ends are ignored; an empty table gives an empty table."""
    e = (edges.where("u is not null and v is not null and u <> v")
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = checkpoint(e)
    before = _digest(e)
    for _ in range(max_rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        e = checkpoint(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        after = _digest(e)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
