"""Queries over properties, port types, templates and bytes on the wire."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolwright.functions import scalars as S
from poolwright.plans.registry import Registry
from poolwright.sources.tables import BASE, event_log, read

REGISTERED = Registry()
query = REGISTERED


def pick(k, *values):
    """One of the values, by k."""
    return F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


@query(
    BASE
    + """, p AS (SELECT event_id, (['pool.', 'net.', 'net.io.'])[(k % 3 + 1)::INT] || name AS key FROM log)
SELECT event_id, substr(key, 5) AS stripped, NOT starts_with(key, 'net.io.') AND key NOT IN ('net.1', 'net.2', 'net.3') AS unknown FROM p WHERE key LIKE 'net.%'"""
)
def property_filter(spark, d):
    key = F.concat(pick(F.col("k"), "pool.", "net.", "net.io."), F.col("name").cast("string"))
    own = event_log(spark, d).select("event_id", key.alias("key")).filter(F.col("key").startswith("net."))
    stripped = F.substring("key", 5, 1000)
    return own.select("event_id", stripped.alias("stripped"), (~stripped.startswith("io.") & ~F.col("key").isin("net.1", "net.2", "net.3")).alias("unknown"))


@query(
    BASE
    + """SELECT event_id, CASE k % 4 WHEN 0 THEN name || '|b' WHEN 1 THEN name::VARCHAR WHEN 2 THEN '' || '|' || name ELSE '' END AS parts, k % 4 = 1 AND name = 7 AS seven,
  CASE k % 4 WHEN 3 THEN NULL WHEN 0 THEN 'tcp' WHEN 1 THEN 'multi:a' ELSE 'nio' END AS impl, CASE k % 4 WHEN 0 THEN 'log;tcp' WHEN 2 THEN 'x' END AS stacked FROM log"""
)
def string_lists(spark, d):
    name, k = F.col("name").cast("string"), F.col("k")
    text = pick(k, F.concat(name, F.lit(" , b,,")), name, F.concat(F.lit(","), name), F.lit(None).cast("string"))
    first, rest = S.implementations(pick(k, F.lit("tcp,log;tcp"), F.lit("multi:a"), F.lit("nio;x"), F.lit(None).cast("string")))
    return event_log(spark, d).select("event_id", F.array_join(S.string_list(text), "|").alias("parts"), S.equals(text, "7").alias("seven"), first.alias("impl"), rest.alias("stacked"))


@query(
    BASE
    + """SELECT event_id, CASE k % 4 WHEN 0 THEN 'c' || name || '@site' || pool || '@org' WHEN 1 THEN 'site' || pool || ':org@x' WHEN 2 THEN '77@%@%WHO%' ELSE 'plain%' END AS place,
  CASE k % 3 WHEN 0 THEN '/home/me/' || name WHEN 1 THEN '${NOPE}' || name || '$' ELSE 'me:/home/me' END AS path FROM log"""
)
def location_template(spark, d):
    k, name = F.col("k"), F.col("name").cast("string")
    host = F.concat(F.lit("c"), name, F.lit(".site"), F.col("pool").cast("string"), F.lit(".org"))
    template = pick(k, "%HOSTNAME%@%DOMAIN%", "%FLAT_DOMAIN%@x", "%PID%@%%@%WHO%", "plain%")
    path = pick(k, F.concat(F.lit("${HOME}/"), name), F.concat(F.lit("${NOPE}"), name, F.lit("$")), F.lit("${USER}:${HOME}"))
    return event_log(spark, d).select("event_id", S.filled(template, host, F.lit(77)).alias("place"), S.expanded(path, {"HOME": "/home/${USER}", "USER": "me"}).alias("path"))


@query(
    BASE
    + """, c AS (SELECT event_id, k, (k & 1) + ((k >> 1) & 1) AS n, (k & 4) > 0 AS ser, (k & 8) > 0 AS light, (k & 16) > 0 AS up, (k & 32) > 0 AS rel, (k & 64) > 0 AS fifo, name % 2 = 0 AS wants FROM log)
SELECT event_id, CASE WHEN n <> 1 THEN 'CONNECTION_TYPES' WHEN NOT ser THEN 'NO_SERIALIZATION' WHEN light AND up THEN 'LIGHT_UPCALLS' WHEN light AND rel THEN 'LIGHT_RELIABLE'
  WHEN light AND fifo THEN 'LIGHT_FIFO' WHEN wants AND NOT up THEN 'UPCALLS_NOT_REQUESTED' END AS fault FROM c"""
)
def port_type_sanity(spark, d):
    bits = ("connection.onetoone", "connection.manytoone", "serialization.object", "connection.light", "connection.upcalls", "communication.reliable", "communication.fifo")
    caps = F.array_compact(F.array(*[F.when(F.col("k").bitwiseAND(F.lit(1 << i)) > 0, F.lit(c)) for i, c in enumerate(bits)]))
    return event_log(spark, d).select("event_id", S.port_fault(caps, F.col("name") % 2 == 0).alias("fault"))


@query(
    BASE
    + """, t AS (SELECT event_id, CASE k % 3 WHEN 0 THEN (k * 1000)::VARCHAR WHEN 1 THEN 'x' || k ELSE '-' || k END AS whole, CASE k % 3 WHEN 0 THEN k || '.5' WHEN 1 THEN k || 'e2' ELSE '' END AS broken FROM log)
SELECT event_id, coalesce(try_cast(whole AS SMALLINT), -1)::SMALLINT AS short_, coalesce(try_cast(whole AS INTEGER), -1)::INTEGER AS int_, coalesce(try_cast(whole AS BIGINT), -1) AS long_,
  coalesce(try_cast(broken AS DOUBLE), 0) AS double_, coalesce(try_cast(broken AS FLOAT), 0)::DOUBLE AS float_ FROM t"""
)
def typed_numbers(spark, d):
    k = F.col("k").cast("string")
    whole = pick(F.col("k"), (F.col("k") * 1000).cast("string"), F.concat(F.lit("x"), k), F.concat(F.lit("-"), k))
    broken = pick(F.col("k"), F.concat(k, F.lit(".5")), F.concat(k, F.lit("e2")), F.lit(""))
    typed = lambda text, kind, default: F.coalesce(text.try_cast(kind), F.lit(default).cast(kind))
    return event_log(spark, d).select(
        "event_id",
        typed(whole, "smallint", -1).alias("short_"), typed(whole, "int", -1).alias("int_"), typed(whole, "long", -1).alias("long_"),
        typed(broken, "double", 0).alias("double_"), typed(broken, "float", 0).cast("double").alias("float_"),
    )


@query(
    BASE
    + """, h AS (SELECT event_id, k, lpad(hex(event_id * 7919), 16, '0') AS a, lpad(hex(k), 4, '0') AS s FROM log)
SELECT event_id, a AS big, a[15:16] || a[13:14] || a[11:12] || a[9:10] || a[7:8] || a[5:6] || a[3:4] || a[1:2] AS little, s AS big_short, s[3:4] || s[1:2] AS little_short, event_id * 7919 AS back FROM h"""
)
def byte_order(spark, d):
    number = F.col("event_id") * 7919
    return event_log(spark, d).select(
        "event_id", S.big_endian(number).alias("big"), S.little_endian(number).alias("little"), S.big_endian(F.col("k"), 2).alias("big_short"), S.little_endian(F.col("k"), 2).alias("little_short"),
        S.from_big_endian(S.big_endian(number)).alias("back"),
    )


@query("SELECT doc_id, length(text) AS chars, strlen(text) + (length(text) - length(replace(text, chr(0), ''))) + 2 * len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS bytes FROM documents")
def text_on_the_wire(spark, d):
    return read(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), S.wire_length(F.col("text")).alias("bytes"))


@query(
    BASE
    + """, c AS (SELECT member, list_sort(list_distinct(list(lower(kind)))) AS caps FROM log GROUP BY member)
SELECT a.member, a.caps = b.caps AS equal, len(list_intersect(a.caps, b.caps)) AS common FROM c a JOIN c b ON b.member = a.member + 8"""
)
def capability_equality(spark, d):
    caps = event_log(spark, d).groupBy("member").agg(S.capabilities(F.collect_set("kind")).alias("caps"))
    other = caps.select((F.col("member") - 8).alias("member"), F.col("caps").alias("other"))
    return caps.join(other, "member").select("member", (F.col("caps") == F.col("other")).alias("equal"), F.size(F.array_intersect("caps", "other")).cast("long").alias("common"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE * 0.5 + embedding[2]::DOUBLE, 9) AS x, round(embedding[2]::DOUBLE * 0.5 + embedding[3]::DOUBLE, 9) AS y FROM embeddings")
def vector_sums(spark, d):
    part = lambda at: F.transform(F.slice("embedding", at, 2), lambda x: x.cast("double"))
    total = S.add(S.scaled(part(1), F.lit(0.5)), part(2))
    return read(spark, d, "embeddings").select("vec_id", F.round(F.get(total, F.lit(0)), 9).alias("x"), F.round(F.get(total, F.lit(1)), 9).alias("y"))
