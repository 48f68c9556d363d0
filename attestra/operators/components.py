"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is one shuffle of the edge list, whose length never grows; what is written between rounds goes
to the folder that driver and executors share, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.sources.shared import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least of them and itself; ``large``: only the neighbours above the node."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
    linked = both.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            least.select("u", F.col("low").alias("v"))
        )
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Null ends and loops are dropped, repeated edges count once, no edges give no rows.
    """
    current = materialize(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    before = None
    for _ in range(max_rounds):
        last, current = current, materialize(_stars(_stars(current, True), False), "cc")
        discard(last)
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def component_members(components: DataFrame) -> DataFrame:
    """Members of each component in order, with their number."""
    w = Window.partitionBy("component").orderBy("node")
    return components.withColumn("position", F.row_number().over(w))
