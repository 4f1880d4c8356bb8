"""Streaming twins: membership folded by a stateful processor, and windowed counts behind a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from poolwright import scratch
from poolwright.session import ship


def drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over what is there now and return what it wrote: Parquet in the shared folder, nothing in the driver. Windows are written once, when the watermark has passed them."""
    name = scratch.path(spark, "stream")
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{name}/rows").option("checkpointLocation", f"{name}/log")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{name}/rows")


def membership(events: DataFrame) -> DataFrame:
    """Effective transitions of each (pool, member) of a stream (event_id, pool, member, kind): state is whether the member is present."""
    ship(events.sparkSession)
    moves = events.filter("kind in ('JOIN', 'LEAVE', 'DIED')")
    return moves.groupBy("pool", "member").applyInPandasWithState(
        _fold, "event_id long, pool long, member long, kind string, delta long", "present boolean", "append", GroupStateTimeout.NoTimeout
    )


#: What changes membership, numbered in the low bits of a packed event.
MOVES = ["JOIN", "LEAVE", "DIED"]
#: Rows of a frame that the fold gives back.
CHUNK = 1 << 16


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A member's events of a micro-batch in order, 8 bytes each: event_id and kind in one number."""
    packed = np.concatenate([f["event_id"].to_numpy() * 4 + pd.Index(MOVES).get_indexer(f["kind"]) for f in frames])
    packed.sort()
    joins = packed & 3 == 0
    before = np.r_[state.get[0] if state.exists else False, joins[:-1]]
    state.update((bool(joins[-1]),))
    packed = packed[joins != before]
    for at in range(0, len(packed), CHUNK):
        some = packed[at : at + CHUNK]
        kinds = np.take(MOVES, some & 3)
        yield pd.DataFrame({"event_id": some >> 2, "pool": key[0], "member": key[1], "kind": kinds, "delta": np.where(some & 3 == 0, 1, -1)})


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by kind and window of their time."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(events: DataFrame, width: str = "2 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by kind and window, windows overlapping; rows later than the watermark are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width, slide).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))


def heartbeat_sessions(events: DataFrame, silence: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Spells of a member without a silence: a spell's end plus the silence is when it becomes suspect."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", silence).alias("w"), "member").agg(F.count(F.lit(1)).alias("n"))
