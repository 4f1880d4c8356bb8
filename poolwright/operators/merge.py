"""Gossip: merging replicas of member state, and what follows from merged state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_members(replicas: DataFrame, now: int, timeout: int, required: int) -> DataFrame:
    """One row per member of (id, last_seen, witness, dead, left): latest sighting, union of witnesses, dead or left if any replica says so.

    Witnesses of a dead or left member are dropped; a timed-out member with more than required witnesses is dead. The merge is commutative and
    idempotent, so replicas may be merged in any order and again.
    """
    merged = replicas.groupBy("id").agg(
        F.max("last_seen").alias("last_seen"),
        F.count_distinct("witness").alias("seen_by"),
        F.bool_or("dead").alias("was_dead"),
        F.bool_or("left").alias("left"),
    )
    late = F.col("last_seen") + timeout < now
    dead = F.col("was_dead") | (late & (F.col("seen_by") > required) & ~F.col("left"))
    witnesses = F.when(F.col("was_dead") | F.col("left"), 0).otherwise(F.col("seen_by"))
    return merged.select("id", "last_seen", witnesses.cast("long").alias("witnesses"), dead.alias("dead"), "left", (~dead & ~F.col("left") & ~late).alias("live"))


def without_tombstones(joins: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Joins of members that are not among the gone, whose set only grows."""
    return joins.join(gone.select(key).distinct(), key, "left_anti")
