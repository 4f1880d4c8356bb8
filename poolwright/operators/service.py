"""What a registry does for its members: answering requests, pushing and calling back events, drawing members, routing, measuring, tracking coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from poolwright.functions.scalars import drawn
from poolwright.operators import ordered

REQUESTS = ("JOIN", "LEAVE", "GET_STATE", "DEAD", "MAYBE_DEAD", "ELECT", "SIGNAL", "SEQUENCE_NR", "HEARTBEAT", "ADD_TOKENS", "GET_TOKEN", "TERMINATE")
#: Requests that become events of the log.
LOGGED = {"JOIN": "JOIN", "LEAVE": "LEAVE", "DEAD": "DIED", "ELECT": "ELECT", "SIGNAL": "SIGNAL", "TERMINATE": "TERMINATE"}


def dispatched(requests: DataFrame) -> DataFrame:
    """requests (pool, time, member, op) with reply, the event that results (null if none) and its place among the pool's events.

    A member may join while it is absent, and do all else while it is present.
    """
    state = F.when(F.col("op") == "JOIN", 1).when(F.col("op").isin("LEAVE", "DEAD"), 0)
    earlier = W.partitionBy("pool", "member").orderBy("time").rowsBetween(W.unboundedPreceding, -1)
    out = requests.withColumn("_state", state).withColumn("_in", F.coalesce(F.last("_state", ignorenulls=True).over(earlier), F.lit(0)) == 1)
    joins = F.col("op") == "JOIN"
    reply = F.when(joins & F.col("_in"), "ALREADY_MEMBER").when(~joins & ~F.col("_in"), "UNKNOWN_MEMBER").otherwise("OK")
    event = F.create_map(*[F.lit(x) for pair in LOGGED.items() for x in pair])
    out = out.withColumn("reply", reply).withColumn("event", F.when(F.col("reply") == "OK", F.try_element_at(event, F.col("op"))))
    counted = ordered.running(out, ["pool"], ["time"], F.col("event").isNotNull().cast("int"), "_n")
    return counted.withColumn("clock", F.when(F.col("event").isNotNull(), F.col("_n") - 1)).drop("_state", "_in", "_n")


def pending(log: DataFrame, seen: DataFrame, keep: int) -> DataFrame:
    """For each member (pool, member, seen): the first event it lacks, how many there are, and whether they are beyond the last keep events."""
    now = log.groupBy("pool").agg(F.max("time").alias("now"))
    out = seen.join(now, "pool")
    start = F.col("seen") + 1
    return out.select("pool", "member", start.alias("start"), (F.col("now") - F.col("seen")).alias("events"), (start < F.col("now") - keep).alias("bootstrap"))


def callbacks(log: DataFrame, elections: DataFrame) -> DataFrame:
    """(pool, time, callback, member, name): what handlers are told of a log. A lost election is told as a result without a winner."""
    called = F.create_map(*[F.lit(x) for pair in (("JOIN", "joined"), ("LEAVE", "left"), ("DIED", "died"), ("SIGNAL", "gotSignal")) for x in pair])
    plain = log.filter("kind <> 'ELECT'").select("pool", "time", F.element_at(called, F.col("kind")).alias("callback"), "member", F.when(F.col("kind") == "SIGNAL", F.col("name")).alias("name"))
    result = F.lit("electionResult").alias("callback")
    won = elections.select("pool", "time", result, F.col("winner").alias("member"), "name")
    lost = elections.filter("lost_at is not null").select("pool", F.col("lost_at").alias("time"), result, F.lit(None).cast("long").alias("member"), "name")
    return plain.unionByName(won).unionByName(lost)


def draw(rows: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each key. Each task keeps n of a key before rows are shuffled."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_place") <= n).drop("_place")


def victims(members: DataFrame, seed: str, itself: bool = False) -> DataFrame:
    """Each member (pool, member) with a random one of its pool; the next one where it drew itself, unless it may."""
    placed = ordered.ranked(members, ["pool"], ["member"], "id")
    n = placed.groupBy("pool").agg(F.count(F.lit(1)).alias("n"))
    number = F.conv(F.substring(drawn(seed, "member"), 1, 8), 16, 10).cast("long") % F.col("n")
    asked = placed.join(n, "pool").withColumn("at", number)
    if not itself:
        asked = asked.withColumn("at", F.when(F.col("at") == F.col("id"), (F.col("at") + 1) % F.col("n")).otherwise(F.col("at")))
    return asked.drop("id").join(placed.select("pool", F.col("id").alias("at"), F.col("member").alias("victim")), ["pool", "at"])


def logp(log: DataFrame, tick: float) -> DataFrame:
    """Round trip, send and receive overhead (less half a tick of the clock) and gap, by pool."""
    part = lambda kind: F.when(F.col("kind") == kind, F.col("value"))
    mean = lambda x: F.round(F.sum(x) / F.count(F.lit(1)) - tick / 2, 9)
    return log.groupBy("pool").agg(mean(F.col("value")).alias("rtt"), mean(part("SIGNAL")).alias("os"), mean(part("JOIN")).alias("or"), F.round(F.avg(part("ELECT")), 9).alias("g"))


def elected(log: DataFrame) -> DataFrame:
    """Winners by pool and name under each pool's kind of registry: the first bidder (central), the least (gossip), or none at all."""
    out = log.filter("kind = 'ELECT'").groupBy("pool", "name", "registry").agg(F.min_by("member", "time").alias("first"), F.min("member").alias("least"))
    winner = F.when(F.col("registry") == "central", F.col("first")).when(F.col("registry") == "gossip", F.col("least"))
    return out.select("pool", "name", "registry", winner.alias("winner"), F.when(F.col("registry") == "none", "UNSUPPORTED").otherwise("OK").alias("outcome"))


def hops(messages: DataFrame, key: str, route: str) -> DataFrame:
    """(key, hop, target, onward): a message that goes from each target to the next, with the destinations that are left."""
    out = messages.select(key, route, F.posexplode(route).alias("at", "target"))
    onward = F.slice(route, F.col("at") + 2, F.greatest(F.size(route) - F.col("at") - 1, F.lit(0)))
    return out.select(key, (F.col("at") + 1).alias("hop"), "target", F.array_join(onward, ",").alias("onward"))


def trees(roots: DataFrame, deepest: int) -> DataFrame:
    """Nodes, depth and payload of trees of root nodes, whose left part has half the nodes, one level after the other."""
    level = roots.select("root", F.col("root").alias("size"))
    levels = []
    for depth in range(1, deepest + 1):
        levels.append(level.select("root", F.lit(depth).cast("long").alias("depth")))
        half = F.floor(F.col("size") / 2)
        level = level.select("root", F.explode(F.array(half, F.col("size") - half - 1)).alias("size")).filter("size > 0")
    every = reduce(DataFrame.unionByName, levels)
    return every.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), (F.count(F.lit(1)) * 16).alias("bytes"))


def losses(sent: DataFrame) -> DataFrame:
    """By pool, of messages (pool, time, dropped): sent, delivered, and gaps that the receiver sees."""
    out = ordered.neighbour(sent, ["pool"], ["time"], "dropped", "before", -1)
    gap = F.col("dropped") & ~F.coalesce("before", F.lit(False))
    return out.groupBy("pool").agg(F.count(F.lit(1)).alias("sent"), F.count_if(~F.col("dropped")).alias("delivered"), F.count_if(gap).alias("gaps"))


def tracked(measured: DataFrame, key: str, order: str, push: bool = True) -> DataFrame:
    """(key, samples, x, y, error): a node's coordinates after all its measurements (rtt; x, y, error of the other), each moving what the last one left.

    Nodes are folded as their sorted partition streams by, so none is held in memory. Points closer than 0.01 push each other off in a random
    direction, which the node and the measurement fix; without push they stay.
    """
    rows = measured.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("at"), "rtt", "x", "y", "error")
    placed = rows.repartition("key").sortWithinPartitions("key", "at")

    def direction(node: int, at: int) -> np.ndarray:
        seed = int.from_bytes(hashlib.md5(f"{node}|{at}".encode()).digest()[:8], "big")
        angle = 2 * np.pi * seed / 2**64
        return np.array([np.cos(angle), np.sin(angle)])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, own, error, n = None, np.zeros(2), 1.0, 0
        for frame in frames:
            done = []
            for k, at, rtt, x, y, other in frame.itertuples(index=False):
                if k != node:
                    if n:
                        done.append((node, n, *own, error))
                    node, own, error, n = k, np.zeros(2), 1.0, 0
                away = own - (x, y)
                gap, weight = float(np.hypot(*away)), error / (error + other)
                if gap >= 0.01:
                    unit = away / gap
                else:
                    unit = direction(k, at) if push else np.zeros(2)
                own = own + 0.1 * weight * (rtt - gap) * unit
                error = min(1.0, abs(gap - rtt) / rtt * 0.1 * weight + error * (1 - 0.1 * weight))
                n += 1
            yield pd.DataFrame(done, columns=["key", "samples", "x", "y", "error"])
        if n:
            yield pd.DataFrame([(node, n, *own, error)], columns=["key", "samples", "x", "y", "error"])

    out = placed.mapInPandas(fold, "key long, samples long, x double, y double, error double")
    return out.withColumnRenamed("key", key)
