"""Connected components of an undirected graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours linked to the least node around it.

    The least neighbour is pre-aggregated; hubs meet their edges in a join whose large partitions may be split.
    """
    if small:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    met = around.join(least, "u")
    if small:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """node and root (the least node of its component) of all nodes with an edge.

    Each round writes the edges to the shared folder; two numbers a round reach the driver. Null ends
    and loops are left out; repeated edges count once. No edges: no rows.
    """
    now = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    for _ in range(most):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sign) == before or not sign[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = tuple(sign)
        now = stored(_star(_star(now, False), True), "edges")
    raise RuntimeError(f"components did not settle in {most} rounds")
