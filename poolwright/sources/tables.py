"""The driver's tables, and how they stand in for pools, members, messages and ports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.operators.log import clock

KINDS = {"signup": "JOIN", "purchase": "LEAVE", "error": "DIED", "click": "ELECT", "view": "SIGNAL"}
POOLS = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a pool event log. Stand-in pools never end, and members may join again."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    events = read(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("member"), (F.col("user_id") % POOLS).alias("pool"), kind.alias("kind"), "value", k.cast("long").alias("k"), (k % 10).cast("long").alias("name")
    )
    return clock(events)


#: The same in DuckDB: CTE log.
LOG = f"""log AS (SELECT event_id, ts, user_id AS member, user_id % {POOLS} AS pool,
  CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} END AS kind, value,
  regexp_extract(props, '[0-9]+')::BIGINT AS k, regexp_extract(props, '[0-9]+')::BIGINT % 10 AS name,
  row_number() OVER (PARTITION BY user_id % {POOLS} ORDER BY event_id) - 1 AS time FROM events)"""
#: CTE moves: effective membership.
MOVES = """moves AS (SELECT * EXCLUDE (state, was), (2 * state - 1)::BIGINT AS delta FROM (SELECT *, lag(state, 1, 0) OVER (PARTITION BY pool, member ORDER BY time) AS was
  FROM (SELECT *, CASE WHEN kind = 'JOIN' THEN 1 WHEN kind IN ('LEAVE', 'DIED') THEN 0 END AS state FROM log) WHERE state IS NOT NULL) WHERE state <> was)"""
SIZES = """sizes AS (SELECT pool, time, size FROM (SELECT *, lag(size) OVER (PARTITION BY pool ORDER BY time) AS b
  FROM (SELECT pool, time, (sum(delta) OVER (PARTITION BY pool ORDER BY time))::BIGINT AS size FROM moves)) WHERE size IS DISTINCT FROM b)"""
BASE = f"WITH {LOG}, {MOVES}, {SIZES}"
