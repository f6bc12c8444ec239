"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise


def _neighbours(e: DataFrame) -> DataFrame:
    """Both directions of each link, with the least neighbour (or the node itself) beside it. A hub's links are split over tasks by adaptive execution, as its side of the join has one row for each node."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    return both.join(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node of ``edges``; the component is its least node.

    Large-star and small-star rounds (Kiveris et al., 2014), each written to the shared folder, until the links no
    longer change: O(log² n) rounds. Nulls and links of a node to itself have no row. Nothing is collected but a count
    and a checksum. Ties can't occur; repeated links count once. An empty table gives an empty result.
    """
    e = edges.select(F.col(f"`{a}`").alias("u"), F.col(f"`{b}`").alias("v")).where("u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        large = _neighbours(e).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
