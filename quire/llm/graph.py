"""Connected components by alternating star contraction, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import staged


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge (u, v); component is the smallest node it reaches.

    Each round points larger neighbours at the smallest one (large star), then smaller ones (small star); edges never
    grow in number. Nulls and loops are left out. Each round's edges are written to the shared folder.
    """
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is its neighbours' least keeps its own edges, which large covers with m = u
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = staged(small.where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
