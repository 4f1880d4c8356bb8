"""The pool event log: logical clock, effective membership, ranges and gaps, purging, bootstrap, elections, latches.

A log has the columns pool, time (dense from 0 within the pool), kind, member, name. Windows are partitioned by member or name within the pool; what follows a
whole pool in order is spread over range partitions (ordered.py), so one pool of all events uses all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from poolwright.operators import ordered

JOINED, GONE = ("JOIN",), ("LEAVE", "DIED")


def clock(events: DataFrame, order: str = "event_id") -> DataFrame:
    """Add the dense logical clock of each pool, from 0."""
    return ordered.ranked(events, ["pool"], [order], "time")


def transitions(log: DataFrame) -> DataFrame:
    """Membership events that change something: a join of an absent member, a leave or death of a present one. Adds delta (+1 or -1).

    A member is absent at first, so a leave before any join is no event.
    """
    state = F.when(F.col("kind").isin(*JOINED), 1).when(F.col("kind").isin(*GONE), 0)
    moves = log.withColumn("state", state).filter("state is not null")
    before = F.lag("state", 1, 0).over(W.partitionBy("pool", "member").orderBy("time"))
    return moves.withColumn("before", before).filter("state <> before").withColumn("delta", (2 * F.col("state") - 1).cast("long")).drop("state", "before")


def size_history(log: DataFrame) -> DataFrame:
    """The step function (pool, time, size) of a pool's size. Every transition changes it by one, so successive sizes differ."""
    return ordered.running(transitions(log).select("pool", "time", "delta"), ["pool"], ["time"], F.col("delta"), "size").select("pool", "time", "size")


def compact(series: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Change points of a step function."""
    out = ordered.neighbour(series.withColumn("_known", F.lit(True)), keys, [time], value, "_before", -1)
    out = ordered.neighbour(out, keys, [time], "_known", "_inner", -1)
    return out.filter(F.col("_inner").isNull() | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_known", "_inner")


def contiguous(log: DataFrame, start: int) -> DataFrame:
    """Events from start on, up to the first gap in each pool's times (nothing if the first event is missing, unlike later ones)."""
    ranks = ordered.ranked(log.filter(F.col("time") >= start), ["pool"], ["time"], "_rank")
    first = ranks.groupBy("pool").agg(F.min("time").alias("_first"))
    return ranks.join(first, "pool").filter(F.col("time") - F.col("_rank") == F.col("_first")).drop("_rank", "_first")


def next_required(log: DataFrame, start: int) -> DataFrame:
    """The last time that follows start without a gap, by pool."""
    return contiguous(log, start).groupBy("pool").agg(F.max("time").alias("reached"))


def low_watermark(acknowledged: DataFrame) -> DataFrame:
    """(pool, low): the least acknowledged time among a pool's members; -1 without members."""
    return acknowledged.groupBy("pool").agg(F.coalesce(F.min("time"), F.lit(-1)).alias("low"))


def purge(log: DataFrame, low: DataFrame) -> DataFrame:
    """Events from the low watermark on."""
    return log.join(low, "pool").filter("time >= low").drop("low")


def bootstrap(*parts: DataFrame) -> DataFrame:
    """Union of partial logs, one event per pool and time."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("pool", "time").agg(F.min(F.struct("kind", "member")).alias("event")).select("pool", "time", "event.kind", "event.member")


def numbered(rows: DataFrame, keys: list[str], *order: str, name: str = "number") -> DataFrame:
    """Sequence numbers from 0 within keys."""
    return ordered.ranked(rows, keys, list(order), name)


def balance(steps: DataFrame, keys: list[str], order: str, delta: Column) -> DataFrame:
    """A counter that never falls below 0: a get from an empty one changes nothing. The running sum less its least value so far, if negative."""
    summed = ordered.running(steps, keys, [order], delta, "_total", low="_least")
    return summed.withColumn("balance", F.col("_total") - F.least(F.lit(0), F.col("_least"))).drop("_total", "_least")


def elections(log: DataFrame) -> DataFrame:
    """(pool, name, time, winner, lost_at): a bid by a member wins if there is no winner; a winner's leave or death reopens the election.

    A sequential fold of the events of one (pool, name), streamed in order from a sorted partition, so no group is held in memory.
    Each name needs its candidates' departures, so only members that ever bid are joined to it.
    """
    moves = transitions(log).select("pool", "time", "member", "delta")
    bids = log.filter("kind = 'ELECT'").select("pool", "name", "time", "member")
    candidates = bids.select("pool", "name", "member").distinct()
    steps = moves.join(candidates, ["pool", "member"]).select("pool", "name", "time", "member", "delta")
    steps = steps.unionByName(bids.withColumn("delta", F.lit(0).cast("long")))
    ordered = steps.repartition("pool", "name").sortWithinPartitions("pool", "name", "time")
    return ordered.select("pool", "name", "time", "member", "delta").mapInPandas(_fold_elections, "pool long, name long, time long, winner long, lost_at long")


def _fold_elections(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, winner, since, present, out = None, None, None, set(), []
    for frame in frames:
        for pool, name, time, member, delta in frame.itertuples(index=False):
            if (pool, name) != key:
                if winner is not None:
                    out.append((*key, since, winner, None))
                key, winner, present = (pool, name), None, set()
            if delta > 0:
                present.add(member)
            elif delta < 0:
                present.discard(member)
                if member == winner:
                    out.append((pool, name, since, winner, time))
                    winner = None
            elif winner is None and member in present:
                winner, since = member, time
        done, out = out, []
        yield pd.DataFrame(done, columns=["pool", "name", "time", "winner", "lost_at"]).astype({"lost_at": "Int64"})
    if winner is not None:
        yield pd.DataFrame([(*key, since, winner, None)], columns=["pool", "name", "time", "winner", "lost_at"]).astype({"lost_at": "Int64"})


def latches(log: DataFrame, close: Column, terminate: Column) -> DataFrame:
    """(pool, closed_at, terminated_at): first times of the triggers; termination closes too."""
    times = log.groupBy("pool").agg(F.min(F.when(close, F.col("time"))).alias("c"), F.min(F.when(terminate, F.col("time"))).alias("t"))
    return times.select("pool", F.least("c", "t").alias("closed_at"), F.col("t").alias("terminated_at"))
