"""Problem 6: references to records that don't exist at the time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import key

SALTS = 16


def current_units(units: DataFrame) -> DataFrame:
    """``key, born, removed`` of each unit: its first creation, and the removal that its latest version (by ``updated_at``) states."""
    at = F.coalesce(F.col("updated_at"), F.col("created_at"), F.timestamp_seconds(F.lit(0)))
    return units.select(key(F.col("ku_id")).alias("key"), F.col("created_at").alias("born"), F.col("removed_at").alias("gone"), at.alias("at")).where("key is not null").groupBy("key").agg(F.min("born").alias("born"), F.max_by(F.struct("gone"), F.struct("at", "gone")).alias("last")).select("key", "born", F.col("last.gone").alias("removed"))


def orphan_ends(edges: DataFrame, units: DataFrame) -> DataFrame:
    """``rel_id, side, reason, created_at`` of each end that leads nowhere when its edge is made.

    Ids are compared without regard to case, width and blanks around them. ``missing``: no such unit; ``deleted``: removed at
    or before the edge's ``created_at``; ``late``: the unit was created after it. Null and blank ids have no row; an edge
    without ``created_at`` can only be missing. Repeated rows count once.

    The distinct keys, not the edges, are looked up (a left anti-join gives the missing ones), and the few columns found are
    joined back; as one unit may hold a large part of the ends, each key is spread over ``SALTS`` salts for that.
    """
    e = edges.select("rel_id", "source_ku_id", "target_ku_id", "created_at").distinct()
    side = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), key(F.col(f"{s}_ku_id")).alias("key")) for s in ("source", "target")))).alias("end")
    ends = e.select("rel_id", "created_at", side).select("rel_id", "created_at", "end.side", "end.key").where("key is not null")
    parents = current_units(units)
    keys = ends.select("key").distinct()
    missing = keys.join(parents, "key", "left_anti").select("key", F.lit(True).alias("missing"), F.lit(None).cast("timestamp").alias("born"), F.lit(None).cast("timestamp").alias("removed"))
    # a unit that was always there can't be the end of an orphan
    bounds = ends.groupBy("key").agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    changed = bounds.join(parents, "key").where((F.col("removed") <= F.col("hi")) | (F.col("born") > F.col("lo"))).select("key", F.lit(False).alias("missing"), F.col("born").cast("timestamp"), F.col("removed").cast("timestamp"))
    suspects = missing.unionByName(changed).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    at = F.col("created_at").cast("timestamp")
    reason = F.when(F.col("missing"), "missing").when(F.col("removed") <= at, "deleted").when(F.col("born") > at, "late")
    met = ends.withColumn("salt", F.pmod(F.xxhash64("rel_id", "side"), F.lit(SALTS)).cast("int")).join(suspects, ["key", "salt"])
    return met.select("rel_id", "side", reason.alias("reason"), "created_at").where("reason is not null").distinct()


def orphan_counts(found: DataFrame, table: str = "ku_relations_v1") -> DataFrame:
    """Number of ends by table, month of ``created_at`` (null where that is null), side and reason."""
    return found.groupBy(F.lit(table).alias("table_name"), F.date_format("created_at", "yyyy-MM").alias("month"), "side", "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
