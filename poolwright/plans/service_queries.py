"""Queries over a registry's requests, what it pushes to its members, random draws, routes and measured traffic."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolwright.functions.scalars import drawn
from poolwright.operators import channel as C
from poolwright.operators import log as L
from poolwright.operators import service
from poolwright.plans.log_queries import REGISTERED as LOGGED
from poolwright.plans.registry import Registry
from poolwright.session import ship
from poolwright.sources.tables import BASE, event_log

REGISTERED = Registry()
query = REGISTERED


@query(
    BASE
    + """, q AS (SELECT pool, time, member, (['JOIN', 'LEAVE', 'GET_STATE', 'DEAD', 'MAYBE_DEAD', 'ELECT', 'SIGNAL', 'SEQUENCE_NR', 'HEARTBEAT', 'ADD_TOKENS', 'GET_TOKEN', 'TERMINATE'])[(k % 12 + 1)::INT] AS op FROM log),
s AS (SELECT *, CASE op WHEN 'JOIN' THEN 1 WHEN 'LEAVE' THEN 0 WHEN 'DEAD' THEN 0 END AS state FROM q),
b AS (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY pool, member ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS present FROM s),
o AS (SELECT *, CASE WHEN op = 'JOIN' THEN CASE WHEN present = 1 THEN 'ALREADY_MEMBER' ELSE 'OK' END WHEN present = 0 THEN 'UNKNOWN_MEMBER' ELSE 'OK' END AS reply FROM b),
e AS (SELECT *, CASE WHEN reply = 'OK' AND op IN ('JOIN', 'LEAVE', 'DEAD', 'ELECT', 'SIGNAL', 'TERMINATE') THEN CASE op WHEN 'DEAD' THEN 'DIED' ELSE op END END AS event FROM o)
SELECT pool, time, op, reply, event, CASE WHEN event IS NOT NULL THEN count(event) OVER (PARTITION BY pool ORDER BY time) - 1 END AS clock FROM e"""
)
def request_dispatch(spark, d):
    ops = F.array(*[F.lit(x) for x in service.REQUESTS])
    requests = event_log(spark, d).select("pool", "time", "member", F.element_at(ops, (F.col("k") % len(service.REQUESTS) + 1).cast("int")).alias("op"))
    return service.dispatched(requests).select("pool", "time", "op", "reply", "event", "clock")


@query(
    BASE
    + """, s AS (SELECT pool, member, max(time) AS seen FROM log GROUP BY ALL), n AS (SELECT pool, max(time) AS now FROM log GROUP BY pool)
SELECT pool, member, seen + 1 AS start, now - seen AS events, seen + 1 < now - 500 AS bootstrap FROM s JOIN n USING (pool)"""
)
def event_push(spark, d):
    # A pool keeps its last 500 events; a member further behind starts anew.
    log = event_log(spark, d)
    seen = log.groupBy("pool", "member").agg(F.max("time").alias("seen"))
    return service.pending(log, seen, keep=500)


@query(
    LOGGED.sql["election_history"]
    .replace("SELECT pool, name, time, member AS winner, parted AS lost_at FROM wins", "")
    .rstrip()
    + """, c AS (SELECT pool, time, CASE kind WHEN 'JOIN' THEN 'joined' WHEN 'LEAVE' THEN 'left' WHEN 'DIED' THEN 'died' ELSE 'gotSignal' END AS callback, member,
  CASE WHEN kind = 'SIGNAL' THEN name END AS name FROM log WHERE kind <> 'ELECT'
  UNION ALL SELECT pool, time, 'electionResult', member, name FROM wins UNION ALL SELECT pool, parted, 'electionResult', NULL, name FROM wins WHERE parted IS NOT NULL)
SELECT pool, time, callback, member, name FROM c"""
)
def event_callbacks(spark, d):
    ship(spark)
    log = event_log(spark, d)
    return service.callbacks(log, L.elections(log))


@query(BASE + ", p AS (SELECT DISTINCT pool, time * 3 AS asked FROM log) SELECT p.pool, asked, event_id FROM p LEFT JOIN log ON log.pool = p.pool AND log.time = p.asked")
def event_lookup(spark, d):
    log = event_log(spark, d)
    asked = log.select("pool", (F.col("time") * 3).alias("asked"))
    found = log.select("pool", F.col("time").alias("asked"), "event_id")
    return asked.join(found, ["pool", "asked"], "left")


@query(BASE + "SELECT member, arg_max(k, event_id) AS entry FROM log GROUP BY member HAVING arg_max(k, event_id) % 4 <> 0")
def cache_entries(spark, d):
    # Every fourth entry belongs to members that only relay.
    newest = event_log(spark, d).groupBy("member").agg(F.max_by("k", "event_id").alias("entry"))
    return newest.filter("entry % 4 <> 0")


@query(
    BASE
    + """, s AS (SELECT pool, member, max(time) AS seen FROM log GROUP BY ALL), n AS (SELECT pool, max(time) AS now FROM log GROUP BY pool)
SELECT pool, member FROM s JOIN n USING (pool) WHERE seen + 20 < now QUALIFY row_number() OVER (PARTITION BY pool ORDER BY md5('suspects|' || pool || '|' || member), member) <= 5"""
)
def random_suspects(spark, d):
    log = event_log(spark, d)
    seen = log.groupBy("pool", "member").agg(F.max("time").alias("seen"))
    late = seen.join(log.groupBy("pool").agg(F.max("time").alias("now")), "pool").filter("seen + 20 < now")
    return service.draw(late, "pool", 5, [drawn("suspects", "pool", "member"), F.col("member")]).select("pool", "member")


@query(BASE + ", f AS (SELECT pool, member, max(time) AS seen FROM log WHERE kind = 'JOIN' GROUP BY ALL) SELECT pool, member FROM f QUALIFY row_number() OVER (PARTITION BY pool ORDER BY seen DESC) <= 25")
def bootstrap_members(spark, d):
    joined = event_log(spark, d).filter("kind = 'JOIN'").groupBy("pool", "member").agg(F.max("time").alias("seen"))
    return service.draw(joined, "pool", 25, [F.col("seen").desc()]).select("pool", "member")


NODES = """, i AS (SELECT pool, member, row_number() OVER (PARTITION BY pool ORDER BY member) - 1 AS id FROM (SELECT DISTINCT pool, member FROM log)),
n AS (SELECT pool, count(*) AS n FROM i GROUP BY pool),
r AS (SELECT i.*, n, ('0x' || substr(md5('victims|' || member), 1, 8))::BIGINT % n AS drawn FROM i JOIN n USING (pool)) """


@query(BASE + NODES + "SELECT r.pool, r.member, v.member AS victim FROM r JOIN i v ON v.pool = r.pool AND v.id = CASE WHEN drawn = r.id THEN (drawn + 1) % n ELSE drawn END")
def victim_selection(spark, d):
    members = event_log(spark, d).select("pool", "member").distinct()
    return service.victims(members, "victims").select("pool", "member", "victim")


@query(BASE + NODES + "SELECT r.pool, r.member, v.member AS drawn FROM r JOIN i v ON v.pool = r.pool AND v.id = r.drawn")
def random_draw(spark, d):
    members = event_log(spark, d).select("pool", "member").distinct()
    return service.victims(members, "victims", itself=True).select("pool", "member", F.col("victim").alias("drawn"))


@query(BASE + "SELECT member, count(DISTINCT name || '/' || k) AS signals FROM log WHERE kind = 'SIGNAL' GROUP BY member")
def merged_signals(spark, d):
    # Two registries of one member, which overlap.
    signals = event_log(spark, d).filter("kind = 'SIGNAL'").select("member", F.concat_ws("/", "name", "k").alias("signal"), "k")
    merged = signals.filter("k < 60").unionByName(signals.filter("k >= 40")).select("member", "signal").distinct()
    return merged.groupBy("member").agg(F.count(F.lit(1)).alias("signals"))


@query(
    BASE
    + """, t AS (SELECT pool, member, sum(k)::DOUBLE / 1048576 AS mib FROM log GROUP BY ALL), s AS (SELECT pool, min(member) AS server FROM log GROUP BY pool)
SELECT pool, count(*) FILTER (WHERE member <> server) AS clients, round(coalesce(avg(mib) FILTER (WHERE member <> server), 0), 12) AS client_mib, round(sum(mib) FILTER (WHERE member = server), 12) AS server_mib FROM t JOIN s USING (pool) GROUP BY pool"""
)
def client_and_server_traffic(spark, d):
    log = event_log(spark, d)
    each = log.groupBy("pool", "member").agg((F.sum("k").cast("double") / 1048576).alias("mib"))
    each = each.join(log.groupBy("pool").agg(F.min("member").alias("server")), "pool")
    client = F.when(F.col("member") != F.col("server"), F.col("mib"))
    return each.groupBy("pool").agg(F.count(client).alias("clients"), F.round(F.coalesce(F.avg(client), F.lit(0.0)), 12).alias("client_mib"), F.round(F.sum(F.when(F.col("member") == F.col("server"), F.col("mib"))), 12).alias("server_mib"))


@query(
    BASE
    + """SELECT pool, round(sum(value) / count(*) - 0.5, 9) AS rtt, round(sum(value) FILTER (WHERE kind = 'SIGNAL') / count(*) - 0.5, 9) AS os,
  round(sum(value) FILTER (WHERE kind = 'JOIN') / count(*) - 0.5, 9) AS "or", round(avg(value) FILTER (WHERE kind = 'ELECT'), 9) AS g FROM log GROUP BY pool"""
)
def logp_parameters(spark, d):
    return service.logp(event_log(spark, d), tick=1.0)


@query(
    BASE
    + """SELECT pool, name, (['central', 'gossip', 'none'])[(pool % 3 + 1)::INT] AS registry, CASE pool % 3 WHEN 0 THEN arg_min(member, time) WHEN 1 THEN min(member) END AS winner,
  CASE WHEN pool % 3 = 2 THEN 'UNSUPPORTED' ELSE 'OK' END AS outcome FROM log WHERE kind = 'ELECT' GROUP BY pool, name"""
)
def registry_strategy(spark, d):
    return service.elected(event_log(spark, d).withColumn("registry", F.element_at(F.array(*map(F.lit, ("central", "gossip", "none"))), (F.col("pool") % 3 + 1).cast("int"))))


@query(
    BASE
    + """, c AS (SELECT member AS a, name AS b, arg_max(kind, time) AS last FROM log WHERE kind IN ('SIGNAL', 'LEAVE') GROUP BY ALL), g AS (SELECT DISTINCT member FROM log WHERE kind = 'DIED')
SELECT a, count(*) FILTER (WHERE last = 'SIGNAL') AS peers, count(*) FILTER (WHERE last = 'SIGNAL' AND b IN (SELECT member FROM g)) AS lost FROM c GROUP BY a"""
)
def connected_peers(spark, d):
    log = event_log(spark, d)
    steps = log.filter("kind in ('SIGNAL', 'LEAVE')").select(F.col("member").alias("a"), F.col("name").alias("b"), "time", F.expr("case when kind = 'SIGNAL' then 1 else 0 end").alias("on"))
    gone = log.filter("kind = 'DIED'").select(F.col("member").alias("b")).distinct()
    lost = C.connected_to(steps.join(gone, "b", "left_semi")).withColumnRenamed("peers", "lost")
    return C.connected_to(steps).join(lost, "a", "left").select("a", "peers", F.coalesce("lost", F.lit(0)).alias("lost"))


@query(
    BASE
    + """, m AS (SELECT event_id, [name, name + 3, name + 6] AS route FROM log WHERE kind = 'SIGNAL'), h AS (SELECT event_id, route, unnest([1, 2, 3]) AS hop FROM m)
SELECT event_id, hop, route[hop] AS target, array_to_string(route[hop + 1:], ',') AS onward FROM h"""
)
def route_split(spark, d):
    messages = event_log(spark, d).filter("kind = 'SIGNAL'").select("event_id", F.array("name", F.col("name") + 3, F.col("name") + 6).alias("route"))
    return service.hops(messages, "event_id", "route")


@query(
    "WITH RECURSIVE "
    + BASE.removeprefix("WITH ")
    + """, t AS (SELECT DISTINCT k AS root FROM log WHERE k > 0), w AS (SELECT root, root AS size, 1 AS depth FROM t UNION ALL
  SELECT w.root, c.size, w.depth + 1 FROM w, LATERAL (SELECT unnest([w.size // 2, w.size - w.size // 2 - 1]) AS size) c WHERE c.size > 0)
SELECT root, count(*) AS nodes, max(depth)::BIGINT AS depth, count(*) * 16 AS bytes FROM w GROUP BY root"""
)
def tree_walk(spark, d):
    roots = event_log(spark, d).filter("k > 0").select(F.col("k").alias("root")).distinct()
    return service.trees(roots, deepest=7)  # k is below 128


@query(
    BASE
    + """, s AS (SELECT pool, time, substr(md5('loss|' || event_id), 1, 1) IN ('0', '1') AS dropped FROM log WHERE kind = 'SIGNAL'),
g AS (SELECT *, lag(dropped, 1, false) OVER (PARTITION BY pool ORDER BY time) AS before FROM s)
SELECT pool, count(*) AS sent, count(*) FILTER (WHERE NOT dropped) AS delivered, count(*) FILTER (WHERE dropped AND NOT before) AS gaps FROM g GROUP BY pool"""
)
def unreliable_delivery(spark, d):
    # A best-effort channel that loses one message in eight; a reliable one delivers what was sent.
    lost = F.substring(drawn("loss", "event_id"), 1, 1).isin("0", "1")
    return service.losses(event_log(spark, d).filter("kind = 'SIGNAL'").select("pool", "time", lost.alias("dropped")))


TRACK = """, o AS (SELECT member, value / 100 + 0.01 AS rtt, (k - 50) / 100.0::DOUBLE AS rx, (name - 5) / 10.0::DOUBLE AS ry, row_number() OVER (PARTITION BY member ORDER BY event_id) AS n FROM log WHERE kind = 'SIGNAL'),
f AS (SELECT member, n, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 1.0::DOUBLE AS e FROM (SELECT DISTINCT member, 0::BIGINT AS n FROM o) UNION ALL
  SELECT member, n, x + u * (x - rx) , y + u * (y - ry), least(1.0, se * 0.1 * w + e * (1 - 0.1 * w)) FROM (
    SELECT f.member, o.n, f.x, f.y, f.e, rx, ry, f.e / (f.e + 0.5) AS w, abs(sqrt((f.x - rx) ** 2 + (f.y - ry) ** 2) - rtt) / rtt AS se,
      CASE WHEN sqrt((f.x - rx) ** 2 + (f.y - ry) ** 2) < 0.01 THEN 0 ELSE 0.1 * f.e / (f.e + 0.5) * (rtt - sqrt((f.x - rx) ** 2 + (f.y - ry) ** 2)) / sqrt((f.x - rx) ** 2 + (f.y - ry) ** 2) END AS u
    FROM f JOIN o ON o.member = f.member AND o.n = f.n + 1))
SELECT member, max(n) AS samples, round(arg_max(x, n), 6) AS x, round(arg_max(y, n), 6) AS y, round(arg_max(e, n), 6) AS error FROM f GROUP BY member"""


@query("WITH RECURSIVE " + BASE.removeprefix("WITH ") + TRACK)
def coordinate_tracking(spark, d):
    ship(spark)
    measured = event_log(spark, d).filter("kind = 'SIGNAL'").select(
        "member", "event_id", (F.col("value") / 100 + 0.01).alias("rtt"), ((F.col("k") - 50) / 100.0).alias("x"), ((F.col("name") - 5) / 10.0).alias("y"), F.lit(0.5).alias("error")
    )
    out = service.tracked(measured, "member", "event_id", push=False)
    return out.select("member", "samples", *[F.round(c, 6).alias(c) for c in ("x", "y", "error")])
