"""Connected components of an edge table by alternating large-star and small-star
rounds: joins and partial aggregates only, so a hub with any number of edges is
never gathered in one task (AQE splits a skewed join side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("small").alias("big"), F.col("big").alias("small")))
    least = both.groupBy(F.col("big").alias("at")).agg(F.min("small").alias("least"))
    least = least.select("at", F.least("at", "least").alias("least"))
    return (edges.join(least, edges["small"] == least["at"])
            .select("big", F.col("least").alias("small")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("big").alias("at")).agg(F.min("small").alias("least"))
    moved = (edges.join(least, edges["big"] == least["at"])
             .select(F.col("small").alias("big"), F.col("least").alias("small"))
             .where("big <> small"))
    return moved.unionByName(least.select(F.col("at").alias("big"), F.col("least").alias("small"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): for every id that has an edge to another, the smallest id
    reachable. Self-loops, nulls and repeated edges are ignored."""
    now = materialize(
        edges.select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(),
        "edges")
    mark = None
    while True:
        told = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("big", "small")), F.lit(0))).first()
        if tuple(told) == mark or told[0] == 0:
            return now.select(F.col("big").alias("id"), F.col("small").alias("component")).unionByName(
                now.select(F.col("small").alias("id"), F.col("small").alias("component")).distinct())
        mark = tuple(told)
        before, now = now, materialize(_small_star(_large_star(now)), "edges")
        release(before)
