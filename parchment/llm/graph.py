"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combine and two joins back, so a
hub with many neighbours is never gathered in one place.  Each round's edges
are written to the shared folder, which bounds the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges(u, v) with u > v, each once."""
    if small:
        sides = edges
    else:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("hub"), F.least("u", "m").alias("m")
    )
    met = sides.join(least, sides.u == least.hub)
    if small:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select(F.col("hub").alias("u"), F.col("m").alias("v"))
        )
    else:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u long, v long) -> (node, component): the smallest node reachable from each
    node that has an edge.  Self loops, repeated edges and either direction are accepted;
    no edges give no rows."""
    now = stored(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        new_mark = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if new_mark == mark or not new_mark["n"]:
            break
        mark = new_mark
        now = stored(_star(_star(now, small=False), small=True), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
