"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations with map-side combine and two joins on a node against one row per node, which AQE can
split where a hub has many edges; nothing is gathered per node. Rounds grow with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import cut


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of (src, dst) that has an edge; a component is named by its smallest id.

    Loops and edges with a null end count for nothing; repeated edges count once; no edges give no rows. A graph that
    needs more than ``max_rounds`` rounds raises a RuntimeError; rounds grow with the logarithm of its size.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = cut(e.where("src is not null and dst is not null and u > v").distinct())
    before = _print(e)
    for _ in range(max_rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        after = _print(e)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"no end after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
