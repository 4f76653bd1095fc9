"""Connected components of a link table by alternating large-star and small-star rounds.

Works on tables only: the driver sees one number per round.  Hubs are reduced
to their smallest neighbour by partial aggregation, and both sides of each
join are plain exchanges, so adaptive execution can split a hub's links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links (a, b)``; component is the smallest node reachable.

    Self links, repeated links and both directions are allowed; nulls are not.  No links give an empty table.
    """
    pairs = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        # Large star: a node's larger neighbours are tied to its smallest neighbour or itself.
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "stars")
        large = pairs.join(low, pairs["a"] == low["u"]).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        low = materialize(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "stars")
        small = large.join(low, large["b"] == low["u"]).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        pairs = materialize(small, "small")
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
