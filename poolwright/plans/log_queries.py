"""Queries over the pool event log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from poolwright.operators import log as L
from poolwright.operators import merge, series
from poolwright.operators.channel import live_at
from poolwright.plans.registry import Registry
from poolwright.session import ship
from poolwright.sources.tables import BASE, event_log

REGISTERED = Registry()
query = REGISTERED


@query(BASE + "SELECT pool, time, event_id, kind, member FROM log")
def event_log_clock(spark, d):
    return event_log(spark, d).select("pool", "time", "event_id", "kind", "member")


@query(BASE + "SELECT pool, time, member, kind, delta FROM moves")
def effective_membership(spark, d):
    return L.transitions(event_log(spark, d)).select("pool", "time", "member", "kind", "delta")


@query(BASE + "SELECT pool, time, size FROM sizes")
def pool_size_history(spark, d):
    return L.size_history(event_log(spark, d))


def _grid(spark, d):
    log = event_log(spark, d)
    sizes = L.size_history(log).select("pool", F.col("time").alias("t"), F.col("size").alias("value"))
    bounds = log.groupBy("pool").agg(F.max("time").alias("duration"))
    return series.as_of(series.grid(bounds).select("pool", "t"), sizes, "pool")


ASOF = """, g AS (SELECT pool, unnest(range(0, m + 2 * greatest(1, m // 100) + 1, greatest(1, m // 100))) AS t FROM (SELECT pool, max(time) AS m FROM log GROUP BY pool)),
a AS (SELECT g.pool, g.t, CASE WHEN s.size IS NULL OR g.t >= e.last THEN -1 ELSE s.size END AS value
  FROM g ASOF LEFT JOIN sizes s ON g.pool = s.pool AND g.t >= s.time LEFT JOIN (SELECT pool, max(time) AS last FROM sizes GROUP BY pool) e ON g.pool = e.pool) """


@query(BASE + ASOF + "SELECT pool, t, value FROM a")
def pool_size_asof_grid(spark, d):
    return _grid(spark, d)


@query(BASE + ASOF + "SELECT t, coalesce(avg(value::DOUBLE) FILTER (WHERE value <> -1), 0) AS mean FROM a GROUP BY t")
def avg_pool_size_over_pools(spark, d):
    return series.mean_known(_grid(spark, d), "t")


@query(
    BASE + "SELECT pool, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k.lower()}" for k in ("JOIN", "LEAVE", "DIED", "ELECT", "SIGNAL")) + " FROM log GROUP BY pool"
)
def event_type_histogram(spark, d):
    kinds = ["JOIN", "LEAVE", "DIED", "ELECT", "SIGNAL"]
    counts = event_log(spark, d).groupBy("pool").pivot("kind", kinds).count()
    return counts.select("pool", *[F.coalesce(k, F.lit(0)).alias(k.lower()) for k in kinds])


@query(BASE + "SELECT pool, name, arg_min(member, time) AS winner, min(time) AS time FROM log WHERE kind = 'ELECT' GROUP BY pool, name")
def election_first_winner(spark, d):
    bids = event_log(spark, d).filter("kind = 'ELECT'")
    return bids.groupBy("pool", "name").agg(F.min_by("member", "time").alias("winner"), F.min("time").alias("time"))


@query(
    BASE.replace("WITH", "WITH RECURSIVE", 1)
    + """, spells AS (SELECT pool, member, time AS joined, lead(time) OVER (PARTITION BY pool, member ORDER BY time) AS parted, delta FROM moves),
bids AS (SELECT l.pool, l.name, l.time, l.member, s.parted FROM log l JOIN spells s ON l.pool = s.pool AND l.member = s.member AND s.delta = 1 AND l.time > s.joined AND (s.parted IS NULL OR l.time < s.parted) WHERE l.kind = 'ELECT'),
nexts AS (SELECT a.pool, a.name, a.time, a.member, a.parted, min(b.time) AS next FROM bids a LEFT JOIN bids b ON a.pool = b.pool AND a.name = b.name AND b.time > a.parted GROUP BY ALL),
wins AS (SELECT n.* FROM nexts n JOIN (SELECT pool, name, min(time) AS time FROM nexts GROUP BY ALL) f USING (pool, name, time)
  UNION ALL SELECT n.* FROM wins w JOIN nexts n ON n.pool = w.pool AND n.name = w.name AND n.time = w.next)
SELECT pool, name, time, member AS winner, parted AS lost_at FROM wins"""
)
def election_history(spark, d):
    return L.elections(event_log(spark, d))


@query(BASE + "SELECT pool, name, min(member) AS winner FROM log WHERE kind = 'ELECT' GROUP BY pool, name")
def gossip_election_winner(spark, d):
    # Candidates are numeric here, so the least number wins whoever bid first.
    return event_log(spark, d).filter("kind = 'ELECT'").groupBy("pool", "name").agg(F.min("member").alias("winner"))


@query(BASE + "SELECT pool, name, time, row_number() OVER (PARTITION BY pool, name ORDER BY time) - 1 AS number FROM log WHERE kind = 'SIGNAL'")
def sequence_numbers(spark, d):
    return L.numbered(event_log(spark, d).filter("kind = 'SIGNAL'"), ["pool", "name"], "time").select("pool", "name", "time", "number")


@query(
    BASE
    + """, s AS (SELECT pool, name, time, CASE WHEN kind = 'ELECT' THEN 1 ELSE -1 END AS step FROM log WHERE kind IN ('ELECT', 'SIGNAL')),
r AS (SELECT *, sum(step) OVER (PARTITION BY pool, name ORDER BY time) AS total FROM s)
SELECT pool, name, time, (total - least(0, min(total) OVER (PARTITION BY pool, name ORDER BY time)))::BIGINT AS balance FROM r"""
)
def token_balance(spark, d):
    steps = event_log(spark, d).filter("kind in ('ELECT', 'SIGNAL')")
    step = F.when(F.col("kind") == "ELECT", 1).otherwise(-1)
    return L.balance(steps, ["pool", "name"], "time", step).select("pool", "name", "time", "balance")


@query(
    BASE
    + """, t AS (SELECT pool, time, member AS sender, unnest([member, member + 8, member + 16]) AS target FROM log WHERE kind = 'SIGNAL')
SELECT pool, time, sender, target FROM t WHERE (SELECT arg_max(delta, time) FROM moves m WHERE m.pool = t.pool AND m.member = t.target AND m.time <= t.time) = 1"""
)
def signal_delivery(spark, d):
    log = event_log(spark, d)
    signals = log.filter("kind = 'SIGNAL'").select("pool", "time", F.col("member").alias("sender"), F.explode(F.array("member", F.col("member") + 8, F.col("member") + 16)).alias("member"))
    return live_at(L.transitions(log), signals).select("pool", "time", "sender", F.col("member").alias("target"))


HOLES = BASE + """, h AS (SELECT * FROM log WHERE time >= 5),
i AS (SELECT *, time - row_number() OVER (PARTITION BY pool ORDER BY time) AS island FROM h),
f AS (SELECT * FROM i WHERE island = (SELECT min(island) FROM i j WHERE j.pool = i.pool)) """


@query(HOLES + "SELECT pool, time, event_id FROM f")
def event_range_contiguous(spark, d):
    return L.contiguous(event_log(spark, d), 5).select("pool", "time", "event_id")


@query(HOLES + "SELECT pool, max(time) AS reached FROM f GROUP BY pool")
def next_required_event(spark, d):
    return L.next_required(event_log(spark, d), 5)


@query(BASE + "SELECT pool, time, member FROM log WHERE kind = 'SIGNAL' AND time BETWEEN 10 AND 200")
def signals_between(spark, d):
    return event_log(spark, d).filter("kind = 'SIGNAL' and time between 10 and 200").select("pool", "time", "member")


@query(BASE + ", w AS (SELECT pool, min(m) AS low FROM (SELECT pool, member, max(time) AS m FROM log GROUP BY ALL) GROUP BY pool) SELECT log.pool, time, kind FROM log JOIN w USING (pool) WHERE time >= low")
def purge_low_watermark(spark, d):
    log = event_log(spark, d)
    seen = log.groupBy("pool", "member").agg(F.max("time").alias("time"))
    return L.purge(log, L.low_watermark(seen)).select("pool", "time", "kind")


@query(BASE + ", s AS (SELECT pool, member, max(time) AS seen FROM log GROUP BY ALL), n AS (SELECT pool, max(time) AS now FROM log GROUP BY pool) SELECT pool, member, seen FROM s JOIN n USING (pool) WHERE seen + 20 < now")
def suspect_members(spark, d):
    log = event_log(spark, d)
    seen = log.groupBy("pool", "member").agg(F.max("time").alias("seen"))
    now = log.groupBy("pool").agg(F.max("time").alias("now"))
    return seen.join(now, "pool").filter("seen + 20 < now").select("pool", "member", "seen")


@query(BASE + "SELECT pool, member, time, gap FROM (SELECT *, lead(time) OVER (PARTITION BY pool, member ORDER BY time) - time AS gap FROM log) WHERE gap > 60")
def missed_heartbeats(spark, d):
    gap = F.lead("time").over(W.partitionBy("pool", "member").orderBy("time")) - F.col("time")
    return event_log(spark, d).withColumn("gap", gap).filter("gap > 60").select("pool", "member", "time", "gap")


@query(
    BASE
    + """, r AS (SELECT member AS id, time AS last_seen, k AS witness, kind = 'DIED' AND k < 5 AS dead, kind = 'LEAVE' AND k < 5 AS "left" FROM log),
m AS (SELECT id, max(last_seen) AS last_seen, count(DISTINCT witness) AS s, bool_or(dead) AS wd, bool_or("left") AS l FROM r GROUP BY id),
x AS (SELECT *, wd OR (last_seen + 100 < 1200 AND s > 30 AND NOT l) AS dead FROM m)
SELECT id, last_seen, CASE WHEN wd OR l THEN 0 ELSE s END AS witnesses, dead, l AS "left", NOT dead AND NOT l AND NOT last_seen + 100 < 1200 AS live FROM x"""
)
def gossip_merge_members(spark, d):
    return merge.merge_members(_replicas(spark, d), now=1200, timeout=100, required=30)


def _replicas(spark, d):
    return event_log(spark, d).select(
        F.col("member").alias("id"), F.col("time").alias("last_seen"), F.col("k").alias("witness"), F.expr("kind = 'DIED' and k < 5").alias("dead"), F.expr("kind = 'LEAVE' and k < 5").alias("left")
    )


@query(BASE + "SELECT pool, time, member FROM log WHERE kind = 'JOIN' AND NOT EXISTS (SELECT 1 FROM log g WHERE g.kind = 'DIED' AND g.k < 10 AND g.member = log.member)")
def tombstone_filter(spark, d):
    log = event_log(spark, d)
    return merge.without_tombstones(log.filter("kind = 'JOIN'"), log.filter("kind = 'DIED' and k < 10"), "member").select("pool", "time", "member")


@query(BASE + "SELECT DISTINCT pool, time, kind, member FROM log WHERE kind IN ('JOIN', 'ELECT', 'SIGNAL') OR time < 100")
def bootstrap_replay(spark, d):
    log = event_log(spark, d).select("pool", "time", "kind", "member")
    return L.bootstrap(log.filter("kind in ('JOIN', 'ELECT')"), log.filter("kind = 'SIGNAL'"), log.filter("time < 100"))


@query(
    BASE
    + """, t AS (SELECT pool, least(min(time) FILTER (WHERE kind = 'JOIN' AND k > 90), min(time) FILTER (WHERE kind = 'SIGNAL' AND k = 99)) AS closed_at,
  min(time) FILTER (WHERE kind = 'SIGNAL' AND k = 99) AS terminated_at FROM log GROUP BY pool)
SELECT pool, closed_at, terminated_at, (SELECT count(*) FROM log l WHERE l.pool = t.pool AND kind = 'JOIN' AND l.time > closed_at) AS refused FROM t"""
)
def pool_latches(spark, d):
    log = event_log(spark, d)
    latched = L.latches(log, F.expr("kind = 'JOIN' and k > 90"), F.expr("kind = 'SIGNAL' and k = 99"))
    late = log.filter("kind = 'JOIN'").join(latched, "pool").filter("time > closed_at").groupBy("pool").agg(F.count(F.lit(1)).alias("refused"))
    return latched.join(late, "pool", "left").withColumn("refused", F.coalesce("refused", F.lit(0)))


@query(BASE + "SELECT pool, time // 100 AS drain, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {n}" for k, n in (("JOIN", "joined"), ("LEAVE", "left_"), ("DIED", "died"))) + " FROM moves GROUP BY ALL")
def membership_drain(spark, d):
    moves = L.transitions(event_log(spark, d)).withColumn("drain", F.expr("time div 100"))
    return moves.groupBy("pool", "drain").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("JOIN", "joined"), ("LEAVE", "left_"), ("DIED", "died"))])


@query(
    BASE
    + """, m AS (SELECT pool % 2 AS sub, member AS own, 'm' || member AS id FROM (SELECT DISTINCT pool, member FROM log)),
j AS (SELECT DISTINCT m.sub, m.id FROM log l JOIN m ON l.pool % 2 = m.sub AND l.member = m.own WHERE l.kind = 'JOIN'),
w AS (SELECT m.sub, min(m.id) AS winner FROM log l JOIN m ON l.pool % 2 = m.sub AND l.member = m.own WHERE l.kind = 'ELECT' GROUP BY m.sub)
SELECT j.sub, count(*) AS members, (SELECT min(winner) FROM w) AS winner FROM j GROUP BY j.sub"""
)
def composite_registry(spark, d):
    log = event_log(spark, d).withColumn("sub", F.col("pool") % 2)
    ids = log.select("sub", "member").distinct().withColumn("id", F.concat(F.lit("m"), F.col("member").cast("string")))
    mapped = log.join(ids, ["sub", "member"])
    joined = mapped.filter("kind = 'JOIN'").select("sub", "id").distinct().groupBy("sub").agg(F.count(F.lit(1)).alias("members"))
    winner = mapped.filter("kind = 'ELECT'").agg(F.min("id").alias("winner"))
    return joined.join(F.broadcast(winner), how="left")  # one row


@query(BASE + "SELECT pool, member, time FROM (SELECT *, time - lag(time) OVER (PARTITION BY pool, member ORDER BY time) AS gap FROM log WHERE kind = 'DIED') WHERE gap IS NULL OR gap >= 30")
def suspect_report_dedupe(spark, d):
    gap = F.col("time") - F.lag("time").over(W.partitionBy("pool", "member").orderBy("time"))
    return event_log(spark, d).filter("kind = 'DIED'").withColumn("gap", gap).filter("gap is null or gap >= 30").select("pool", "member", "time")


@query(BASE + "SELECT member AS id, max(time) AS last_seen, count(DISTINCT k) AS witnesses, bool_or(kind = 'DIED' AND k < 5) AS dead FROM log GROUP BY member")
def gossip_round_merge(spark, d):
    # Two replicas that overlap, and one of them again.
    seen = _replicas(spark, d)
    both = seen.filter("witness < 60").unionByName(seen.filter("witness >= 40")).unionByName(seen.filter("witness < 60"))
    return both.groupBy("id").agg(F.max("last_seen").alias("last_seen"), F.count_distinct("witness").alias("witnesses"), F.bool_or("dead").alias("dead"))


@query(BASE + "SELECT pool, min((epoch_us(ts) // 1000)) AS start_ms, max((epoch_us(ts) // 1000)) AS end_ms, (max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) / 1000.0::DOUBLE AS seconds FROM log GROUP BY pool")
def experiment_bounds(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    out = event_log(spark, d).groupBy("pool").agg(F.min(ms).alias("start_ms"), F.max(ms).alias("end_ms"))
    return out.withColumn("seconds", (F.col("end_ms") - F.col("start_ms")) / 1000.0)


@query(BASE + ", f AS (SELECT pool, member, min(time) AS time FROM log GROUP BY ALL) SELECT pool, member, row_number() OVER (PARTITION BY pool ORDER BY time) - 1 AS id FROM f")
def dense_ids(spark, d):
    first = event_log(spark, d).groupBy("pool", "member").agg(F.min("time").alias("time"))
    return L.numbered(first, ["pool"], "time", name="id").select("pool", "member", "id")


@query(BASE + "SELECT pool, time, row_number() OVER (PARTITION BY pool ORDER BY time) AS elections FROM log WHERE kind = 'ELECT'")
def running_elections(spark, d):
    bids = event_log(spark, d).filter("kind = 'ELECT'")
    return L.numbered(bids, ["pool"], "time").select("pool", "time", (F.col("number") + 1).alias("elections"))


for _name in ("election_history",):
    _plain = REGISTERED.queries[_name]
    REGISTERED.queries[_name] = lambda spark, d, f=_plain: (ship(spark), f(spark, d))[1]
