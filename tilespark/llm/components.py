"""Connected components by alternating large and small stars.

Every step is a group-by minimum (combined before its shuffle) and a join that
the adaptive skew handling can split; edges are stored in the shared folder
after each round, so lineage stays short and nothing meets on the driver but
one row of totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import partitions, stored


def _totals(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1_000_003))).first())


EDGES_A_PART = 100_000


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(u, v) edges of any sortable type -> (u, v): every node but the smallest of its
    component, with that smallest node.  Null ends and loops are ignored."""
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _totals(e)
    for _ in range(max_rounds):
        if not before[0]:
            return e
        # few edges need few files: parts follow the number of edges up to the session's partitions
        parts = min(partitions(e.sparkSession), before[0] // EDGES_A_PART + 1)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored: as a side of its own, each join can split a node with very many links
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts), "least")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts), "large-star")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), "low")
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = stored(small.coalesce(parts), "small-star")
        now = _totals(e)
        if now == before:
            return e
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
