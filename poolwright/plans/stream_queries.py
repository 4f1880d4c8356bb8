"""Structured Streaming queries, run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolwright.plans.registry import Registry
from poolwright.sources.tables import BASE, KINDS, POOLS
from poolwright.streaming import membership as M

REGISTERED = Registry()
query = REGISTERED


def _events(spark, d):
    path = f"{d}/events.parquet"
    # A file stream reads folders, so the table's file is picked out of its own.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(d)
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    return stream.select("event_id", "ts", F.col("user_id").alias("member"), (F.col("user_id") % POOLS).alias("pool"), kind.alias("kind"))


@query(BASE + "SELECT event_id, pool, member, kind, delta FROM moves")
def stream_membership(spark, d):
    return M.drain(spark, M.membership(_events(spark, d)))


#: The watermark follows the latest event by a day; windows that end later are not yet written.
MARK = "(SELECT epoch_us(max(ts)) // 1000 - 86400000 FROM log)"


@query(BASE + f", w AS (SELECT kind, epoch_ms(date_trunc('day', ts)) AS day_ms FROM log) SELECT day_ms, kind, count(*) AS n FROM w GROUP BY day_ms, kind HAVING day_ms + 86400000 <= {MARK}")
def stream_tumbling_counts(spark, d):
    out = M.drain(spark, M.tumbling_counts(_events(spark, d)))
    return out.select(F.unix_millis("w.start").alias("day_ms"), "kind", "n")


@query(
    BASE
    + f""", w AS (SELECT kind, unnest([epoch_ms(date_trunc('day', ts)), epoch_ms(date_trunc('day', ts)) - 86400000]) AS start_ms FROM log)
SELECT start_ms, kind, count(*) AS n FROM w GROUP BY ALL HAVING start_ms + 172800000 <= {MARK}"""
)
def stream_sliding_counts(spark, d):
    out = M.drain(spark, M.sliding_counts(_events(spark, d)))
    return out.select(F.unix_millis("w.start").alias("start_ms"), "kind", "n")


@query(
    BASE
    + f""", g AS (SELECT member, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY member ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS first FROM log),
s AS (SELECT *, sum(first) OVER (PARTITION BY member ORDER BY ts) AS spell FROM g)
SELECT member, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 + 43200000 AS suspect_ms, count(*) AS n FROM s GROUP BY member, spell HAVING suspect_ms <= {MARK}"""
)
def stream_heartbeat_sessions(spark, d):
    out = M.drain(spark, M.heartbeat_sessions(_events(spark, d)))
    return out.select("member", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("suspect_ms"), "n")
