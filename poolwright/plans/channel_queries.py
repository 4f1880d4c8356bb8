"""Queries over messages, ports, connections and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from poolwright.functions.rpc import register
from poolwright.functions.scalars import drawn
from poolwright.operators import channel as C
from poolwright.operators import series
from poolwright.plans.registry import Registry
from poolwright.sources.tables import BASE, event_log, read

REGISTERED = Registry()
query = REGISTERED
IN = "kind IN ('JOIN', 'ELECT')"


@query(BASE + f"SELECT kind, sum(value) AS total_time, count(*) FILTER (WHERE {IN}) AS in_cnt, count(*) FILTER (WHERE NOT {IN}) AS out_cnt, sum(k)::BIGINT AS bytes, sum(k)::DOUBLE / 1048576 AS mib, sum(value) / count(*) / 1000 AS avg_seconds FROM log GROUP BY kind")
def comm_stats_by_opcode(spark, d):
    n, inward = F.count(F.lit(1)), F.col("kind").isin("JOIN", "ELECT")
    return event_log(spark, d).groupBy("kind").agg(
        F.sum("value").alias("total_time"),
        F.count_if(inward).alias("in_cnt"),
        F.count_if(~inward).alias("out_cnt"),
        F.sum("k").alias("bytes"),
        (F.sum("k").cast("double") / 1048576).alias("mib"),
        (F.when(n == 0, 0.0).otherwise(F.sum("value") / n) / 1000).alias("avg_seconds"),
    )


@query(BASE + "SELECT count(*) AS messages, sum(k)::BIGINT AS bytes, CASE WHEN count(*) = 0 THEN 'NaN'::DOUBLE ELSE sum(value) / count(*) END AS avg_time FROM log")
def grand_totals(spark, d):
    n = F.count(F.lit(1))
    return event_log(spark, d).agg(n.alias("messages"), F.sum("k").alias("bytes"), F.when(n == 0, float("nan")).otherwise(F.sum("value") / n).alias("avg_time"))


@query(BASE + ", f AS (SELECT unnest([member, member + 1, member + 2]) AS peer, k FROM log WHERE kind = 'SIGNAL') SELECT peer, sum(k)::BIGINT AS bytes FROM f GROUP BY peer")
def bytes_per_peer(spark, d):
    # A multicast counts once for each receiver.
    sent = event_log(spark, d).filter("kind = 'SIGNAL'").select(F.explode(F.array("member", F.col("member") + 1, F.col("member") + 2)).alias("peer"), "k")
    return sent.groupBy("peer").agg(F.sum("k").alias("bytes"))


@query(BASE + "SELECT member, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(DISTINCT name) AS peers FROM log GROUP BY member")
def connection_types_per_peer(spark, d):
    return event_log(spark, d).groupBy("member").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count_distinct("name").alias("peers"))


#: The connections that come about: by port, the first sender that is let in, and the others' first where many may be.
REQUESTS = """, r AS (SELECT name AS port, event_id AS seq, member AS sender, CASE WHEN k % 7 = 0 THEN 9 ELSE name % 3 END AS type, k % 5 <> 3 AS granted FROM log WHERE kind = 'SIGNAL'),
ok AS (SELECT r.port, r.sender, min(r.seq) AS seq, any_value(many) AS many FROM r JOIN p ON r.port = p.port AND r.type = p.type AND p.enabled AND r.granted GROUP BY ALL),
links AS (SELECT port, sender, seq FROM ok WHERE many OR NOT EXISTS (SELECT 1 FROM ok o WHERE o.port = ok.port AND o.seq < ok.seq)) """
PORTS = ", p AS (SELECT DISTINCT name AS port, name % 3 AS type, name % 4 <> 0 AS enabled, name % 2 = 0 AS many FROM log WHERE name < 9)"


@query(
    BASE + PORTS
    + REQUESTS
    + """SELECT r.port, r.seq, r.sender, CASE WHEN p.port IS NULL THEN 'NOT_PRESENT' WHEN EXISTS (SELECT 1 FROM links l WHERE l.port = r.port AND l.sender = r.sender AND l.seq < r.seq) THEN 'ALREADY_CONNECTED'
  WHEN r.type <> p.type THEN 'TYPE_MISMATCH' WHEN NOT p.enabled THEN 'DISABLED' WHEN NOT p.many AND EXISTS (SELECT 1 FROM links l WHERE l.port = r.port AND l.seq < r.seq) THEN 'NO_MANY_TO_X'
  WHEN NOT r.granted THEN 'DENIED' ELSE 'ACCEPTED' END AS outcome FROM r LEFT JOIN p ON r.port = p.port"""
)
def connection_admission(spark, d):
    return C.admit(*_ports(spark, d))


def _ports(spark, d):
    log = event_log(spark, d)
    ports = log.filter("name < 9").select("name").distinct().select(F.col("name").alias("port"), F.expr("name % 3").alias("type"), F.expr("name % 4 <> 0").alias("enabled"), F.expr("name % 2 = 0").alias("many"))
    requests = log.filter("kind = 'SIGNAL'").select(F.col("name").alias("port"), F.col("event_id").alias("seq"), F.col("member").alias("sender"), F.expr("case when k % 7 = 0 then 9 else name % 3 end").alias("type"), F.expr("k % 5 <> 3").alias("granted"))
    return requests, ports


@query(
    BASE + PORTS + REQUESTS
    + """SELECT r.sender AS member, count(DISTINCT r.port) AS wanted, (SELECT count(*) FROM links l WHERE l.sender = r.sender) AS connected,
  count(DISTINCT r.port) = (SELECT count(*) FROM links l WHERE l.sender = r.sender) AS complete FROM r GROUP BY r.sender"""
)
def bulk_connect_outcome(spark, d):
    # Each member wants all ports it ever asked for, asking again until it is let in; the whole succeeds if every port does.
    tries = C.admit(*_ports(spark, d)).groupBy("sender", "port").agg(F.max(F.col("outcome") == "ACCEPTED").alias("in"))
    out = tries.groupBy(F.col("sender").alias("member")).agg(F.count(F.lit(1)).alias("wanted"), F.count_if("in").alias("connected"))
    return out.withColumn("complete", F.col("wanted") == F.col("connected"))


@query(BASE + "SELECT DISTINCT member, name AS peer FROM log l WHERE kind = 'SIGNAL' AND NOT EXISTS (SELECT 1 FROM log g WHERE g.kind = 'DIED' AND g.k < 8 AND g.member = l.name)")
def death_cascade(spark, d):
    log = event_log(spark, d)
    gone = log.filter("kind = 'DIED' and k < 8").select(F.col("member").alias("peer")).distinct()
    return log.filter("kind = 'SIGNAL'").select("member", F.col("name").alias("peer")).distinct().join(gone, "peer", "left_anti").select("member", "peer")


@query("SELECT c.conv_id, c.turn, r.r_name AS receiver FROM conversations c CROSS JOIN region r")
def fanout_multicast(spark, d):
    receivers = read(spark, d, "region").select(F.col("r_name").alias("receiver"))  # a fixed table of five rows
    return read(spark, d, "conversations").select("conv_id", "turn").crossJoin(F.broadcast(receivers))


@query("SELECT port, conv_id, turn, delivery FROM (SELECT *, row_number() OVER (PARTITION BY port ORDER BY t, conv_id) - 1 AS delivery FROM (SELECT conv_id % 16 AS port, conv_id, turn, row_number() OVER (PARTITION BY conv_id % 16, conv_id ORDER BY turn) AS t FROM conversations))")
def fanin_merge_fifo(spark, d):
    messages = read(spark, d, "conversations").select((F.col("conv_id") % 16).alias("port"), "conv_id", "turn")
    return C.round_robin(messages, "port", "conv_id", "turn").select("port", "conv_id", "turn", "delivery")


@query("WITH u AS (SELECT conv_id, turn, (SELECT min(turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'assistant' AND b.turn > a.turn) AS reply FROM conversations a WHERE role = 'user') SELECT * FROM u WHERE reply IS NOT NULL")
def request_reply(spark, d):
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role")
    later = W.partitionBy("conv_id").orderBy("turn").rowsBetween(1, W.unboundedFollowing)
    reply = F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(later)
    return turns.withColumn("reply", reply).filter("role = 'user' and reply is not null").select("conv_id", "turn", "reply")


@query(
    BASE
    + """, c AS (SELECT event_id AS request, unnest([name, name + 3, name + 6]) AS member, unnest([0, 1, 2]) AS pos FROM log WHERE kind = 'ELECT'),
l AS (SELECT DISTINCT member FROM log WHERE kind = 'JOIN')
SELECT request, coalesce(arg_min(member, pos) FILTER (WHERE member IN (SELECT member FROM l)), arg_min(member, pos)) AS chosen FROM c GROUP BY request"""
)
def first_living_candidate(spark, d):
    log = event_log(spark, d)
    wanted = log.filter("kind = 'ELECT'").select(F.col("event_id").alias("request"), F.posexplode(F.array("name", F.col("name") + 3, F.col("name") + 6)).alias("pos", "member"))
    return C.first_living(wanted, log.filter("kind = 'JOIN'"))


@query(
    BASE
    + """, c AS (SELECT event_id AS request, unnest([name, name + 3, name + 6]) AS member, unnest([0, 1, 2]) AS pos FROM log WHERE kind = 'ELECT'),
l AS (SELECT DISTINCT member FROM log WHERE kind = 'JOIN')
SELECT request, min(pos) AS hop, arg_min(member, pos) AS target, 2 - min(pos) AS remaining FROM c WHERE member IN (SELECT member FROM l) GROUP BY request"""
)
def next_hop(spark, d):
    log = event_log(spark, d)
    route = log.filter("kind = 'ELECT'").select(F.col("event_id").alias("request"), F.posexplode(F.array("name", F.col("name") + 3, F.col("name") + 6)).alias("pos", "member"))
    reachable = route.join(log.filter("kind = 'JOIN'").select("member").distinct(), "member", "left_semi")
    hop = reachable.groupBy("request").agg(F.min("pos").alias("hop"), F.min_by("member", "pos").alias("target"))
    return hop.withColumn("remaining", 2 - F.col("hop"))


@query("SELECT doc_id, greatest(1, ceil(length(text) / 512.0))::BIGINT AS packets, md5(text) AS digest FROM documents")
def fragment_reassemble(spark, d):
    packets = C.fragments(read(spark, d, "documents"), "doc_id", "text", 512)
    return C.reassemble(packets, "doc_id").select("doc_id", "packets", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, length(text) AS size FROM conversations")
def message_combine_split(spark, d):
    combined = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("size")))).alias("parts"))
    return combined.select("conv_id", F.inline("parts"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS number, strlen(text) AS bytes, (sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS total, string_split(text, ' ')[2] AS second FROM conversations")
def message_accounting(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    size = F.octet_length("text").cast("long")
    return read(spark, d, "conversations").select(
        "conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("number"), size.alias("bytes"), F.sum(size).over(w).alias("total"), F.get(F.split("text", " "), F.lit(1)).alias("second")
    )


@query(BASE + "SELECT member, min(value) AS rtt FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY event_id) AS n FROM log) WHERE n <= 4 GROUP BY member")
def rtt_min(spark, d):
    n = F.row_number().over(W.partitionBy("member").orderBy("event_id"))
    return event_log(spark, d).withColumn("n", n).filter("n <= 4").groupBy("member").agg(F.min("value").alias("rtt"))


@query(
    BASE
    + """SELECT pool, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS deviation, CASE WHEN avg(value) = 0 THEN 0 ELSE floor(coalesce(stddev_samp(value), 0) / avg(value) * 100 + 0.5) END AS error,
  ceil(sum(k) / count(*) * 1000.0 / 1048576.0 * 100) / 100 AS mbs, sum(value) * 1000.0 / count(*) AS micros FROM log GROUP BY pool"""
)
def latency_throughput_stats(spark, d):
    mean, deviation, error = series.spread(F.col("value"))
    n = F.count(F.lit(1))
    return event_log(spark, d).groupBy("pool").agg(
        mean.alias("mean"), deviation.alias("deviation"), error.alias("error"), series.megabytes_per_second(F.sum("k"), n).alias("mbs"), (F.sum("value") * 1000.0 / n).alias("micros")
    )


@query(BASE + "SELECT kind, count(*) AS n, sum(value) AS total, avg(value) AS mean, max(value) AS longest, min(value) AS shortest, arg_max(value, event_id) AS last FROM log GROUP BY kind")
def timer_summary(spark, d):
    v = F.col("value")
    return event_log(spark, d).groupBy("kind").agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.max(v).alias("longest"), F.min(v).alias("shortest"), F.max_by("value", "event_id").alias("last")
    )


@query(BASE + "SELECT pool, sum(k)::BIGINT AS requests, (sum(k) // count(*))::BIGINT AS mean, min(k) AS best, arg_min(event_id, (k, event_id)) AS best_run, sum(k) * 1000.0::DOUBLE / max(time) AS per_second FROM log GROUP BY pool")
def steal_stats(spark, d):
    out = event_log(spark, d).groupBy("pool").agg(
        F.sum("k").alias("requests"), F.count(F.lit(1)).alias("n"), F.min("k").alias("best"), F.min_by("event_id", F.struct("k", "event_id")).alias("best_run"), F.max("time").alias("t")
    )
    return out.select("pool", "requests", F.expr("requests div n").alias("mean"), "best", "best_run", (F.col("requests") * 1000.0 / F.col("t")).alias("per_second"))


@query(BASE + "SELECT pool, time // 50 AS round, string_agg(member::VARCHAR, ',' ORDER BY time) AS gathered, max(time) AS done FROM log GROUP BY ALL")
def gather_barrier(spark, d):
    rounds = event_log(spark, d).withColumn("round", F.expr("time div 50")).groupBy("pool", "round")
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("time", "member"))), lambda x: x["member"].cast("string"))
    return rounds.agg(F.array_join(gathered, ",").alias("gathered"), F.max("time").alias("done"))


@query(
    BASE
    + """, c AS (SELECT member AS a, name AS b, time, CASE WHEN kind = 'SIGNAL' THEN 1 ELSE 0 END AS "on" FROM log WHERE kind IN ('SIGNAL', 'LEAVE')),
p AS (SELECT *, coalesce(lag("on") OVER (PARTITION BY a, b ORDER BY time), 0) AS was FROM c)
SELECT a, b, time, CASE WHEN "on" = 1 AND was = 1 THEN 'ALREADY_CONNECTED' WHEN "on" = 0 AND was = 0 THEN 'NOT_CONNECTED' WHEN "on" = 1 THEN 'CONNECTED' ELSE 'DISCONNECTED' END AS outcome FROM p"""
)
def connection_lifecycle(spark, d):
    steps = event_log(spark, d).filter("kind in ('SIGNAL', 'LEAVE')")
    steps = steps.select(F.col("member").alias("a"), F.col("name").alias("b"), "time", F.expr("case when kind = 'SIGNAL' then 1 else 0 end").alias("on"))
    return C.lifecycle(steps).select("a", "b", "time", "outcome")


@query(BASE + "SELECT pool, n, 'events=' || n || ';members=' || m AS shown FROM (SELECT pool, count(*) AS n, count(DISTINCT member) AS m FROM log GROUP BY pool)")
def management_attributes(spark, d):
    totals = event_log(spark, d).groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("member").alias("m"))
    held = F.create_map(F.lit("members"), F.col("m").cast("string"), F.lit("events"), F.col("n").cast("string"))
    kept = totals.select("pool", held.alias("held"))
    shown = F.array_join(F.transform(F.array_sort(F.map_keys("held")), lambda key: F.concat(key, F.lit("="), F.element_at("held", key))), ";")
    return kept.select("pool", F.element_at("held", "events").cast("long").alias("n"), shown.alias("shown"))


@query(BASE + "SELECT pool, CASE WHEN b > 1e6 THEN printf('%.2f', b / 1e6) || ' Mbit/s' ELSE printf('%.2f', b / 1e3) || ' Kbit/s' END AS rate, CASE WHEN m > 1 THEN 1000 / log2(m) ELSE 1000 END AS interval, (n + 7) & ~7 AS aligned FROM (SELECT pool, sum(k) * 8.0::DOUBLE AS b, count(DISTINCT member)::DOUBLE AS m, count(*) AS n FROM log GROUP BY pool)")
def unit_scaling(spark, d):
    from poolwright.functions.scalars import align

    t = event_log(spark, d).groupBy("pool").agg((F.sum("k") * 8.0).alias("b"), F.count_distinct("member").cast("double").alias("m"), F.count(F.lit(1)).alias("n"))
    interval = F.when(F.col("m") > 1, 1000 / F.log2("m")).otherwise(1000.0)
    return t.select("pool", C.in_units(F.col("b")).alias("rate"), interval.alias("interval"), align(F.col("n"), 8).alias("aligned"))


@query(BASE + "SELECT pool, kind, dense_rank() OVER (PARTITION BY pool ORDER BY f) + 1 AS handle, n FROM (SELECT pool, kind, min(time) AS f, count(*) AS n FROM log GROUP BY ALL)")
def handle_interning(spark, d):
    first = event_log(spark, d).groupBy("pool", "kind").agg(F.min("time").alias("f"), F.count(F.lit(1)).alias("n"))
    return first.select("pool", "kind", (F.dense_rank().over(W.partitionBy("pool").orderBy("f")) + 1).cast("long").alias("handle"), "n")


@query(
    BASE
    + """, c AS (SELECT event_id, k, CASE kind WHEN 'JOIN' THEN 'square' WHEN 'LEAVE' THEN 'inverse' ELSE 'missing' END AS method FROM log)
SELECT event_id, method <> 'missing' AND NOT (method = 'inverse' AND k = 0) AS ok, CASE method WHEN 'square' THEN k * k WHEN 'inverse' THEN CASE WHEN k > 0 THEN 1000 // k END END AS result FROM c"""
)
def rpc_invoke(spark, d):
    register(spark, "invoke", {"square": lambda x: x * x, "inverse": lambda x: 1000 // x})
    method = F.when(F.col("kind") == "JOIN", "square").when(F.col("kind") == "LEAVE", "inverse").otherwise("missing")
    event_log(spark, d).select("event_id", "k", method.alias("method")).createOrReplaceTempView("rpc_calls")
    return spark.sql("SELECT event_id, ok, result FROM rpc_calls, LATERAL invoke(method, k)")


@query(BASE + "SELECT member, max(event_id) AS entry FROM log GROUP BY member ORDER BY md5('17|' || member), member LIMIT 25")
def bounded_cache(spark, d):
    """The newest entry of each member, then 25 of them in hash order: a top-k report."""
    newest = event_log(spark, d).groupBy("member").agg(F.max("event_id").alias("entry"))
    return newest.orderBy(drawn("17", "member"), "member").limit(25)
