"""Queries over locations, capability sets, coordinates, properties and other scalar domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolwright.functions import scalars as S
from poolwright.operators import ordered
from poolwright.plans.registry import Registry
from poolwright.sources.tables import BASE, event_log, read

REGISTERED = Registry()
query = REGISTERED
PLACES = "p AS (SELECT c_custkey, c_name || '@' || n_name || '@' || r_name AS loc, n_name, r_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _places(spark, d):
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = read(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("c_custkey", F.concat_ws("@", "c_name", "n_name", "r_name").alias("loc"))


@query(f"WITH {PLACES} SELECT c_custkey, 3::BIGINT AS levels, r_name AS coarsest, n_name || '@' || r_name AS parent FROM p")
def location_levels(spark, d):
    parts = S.levels(F.col("loc"))
    return _places(spark, d).select("c_custkey", F.size(parts).cast("long").alias("levels"), F.get(F.reverse(parts), F.lit(0)).alias("coarsest"), S.render(S.parent(parts)).alias("parent"))


@query(f"WITH {PLACES}, q AS (SELECT *, lead(r_name) OVER w AS r2, lead(n_name) OVER w AS n2, lead(c_name) OVER w AS c2 FROM p WINDOW w AS (PARTITION BY c_custkey % 10 ORDER BY c_custkey)) SELECT c_custkey, (CASE WHEN r_name <> r2 THEN 0 WHEN n_name <> n2 THEN 1 WHEN c_name <> c2 THEN 2 ELSE 3 END)::BIGINT AS matching FROM q WHERE r2 IS NOT NULL")
def location_matching_levels(spark, d):
    places = _places(spark, d).withColumn("ring", F.col("c_custkey") % 10)
    pairs = ordered.neighbour(places, ["ring"], ["c_custkey"], "loc", "other", 1).filter("other is not null")
    return pairs.select("c_custkey", S.matching_levels(S.levels(F.col("loc")), S.levels(F.col("other"))).alias("matching"))


@query(f"WITH {PLACES}, o AS (SELECT c_custkey, r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name, c_name) AS k, count(*) OVER (PARTITION BY r_name) AS n FROM p), m AS (SELECT r_name, min(k) FILTER (WHERE c_custkey % 7 = 0) AS mine FROM o GROUP BY r_name) SELECT c_custkey, (k - mine - 1 + n) % n AS place FROM o JOIN m USING (r_name) WHERE mine IS NOT NULL")
def location_sort_ring(spark, d):
    # In each region, sorted by coarse to fine levels, the one after the region's first customer divisible by 7 comes first.
    parts = S.levels(F.col("loc"))
    placed = _places(spark, d).select("c_custkey", F.get(parts, F.lit(2)).alias("region"), F.reverse(parts).alias("key"))
    placed = ordered.ranked(placed, ["region"], ["key"], "k")
    rings = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("c_custkey") % 7 == 0, F.col("k"))).alias("mine"))
    placed = placed.join(rings, "region").filter("mine is not null")
    return placed.select("c_custkey", ((F.col("k") - F.col("mine") - 1 + F.col("n")) % F.col("n")).alias("place"))


CAPS = BASE + ", c AS (SELECT member, list_sort(list_distinct(list(lower(kind)))) AS caps FROM log GROUP BY member) "


@query(CAPS + "SELECT member, array_to_string(caps, ',') AS caps, list_contains(caps, 'join') AS can_join, list_has_all(caps, ['elect', 'signal']) AS matched, array_to_string(list_filter(['elect', 'signal'], lambda x: NOT list_contains(caps, x)), ',') AS unmatched, len(list_filter(caps, lambda x: starts_with(x, 'e'))) AS with_e FROM c")
def capability_match(spark, d):
    caps = event_log(spark, d).groupBy("member").agg(S.capabilities(F.collect_set("kind")).alias("caps"))
    wanted, held = F.array(F.lit("elect"), F.lit("signal")), F.col("caps")
    return caps.select(
        "member",
        F.array_join(held, ",").alias("caps"),
        S.has_capability(held, "JOIN").alias("can_join"),
        S.matches(wanted, held).alias("matched"),
        F.array_join(F.array_except(wanted, held), ",").alias("unmatched"),
        F.size(S.with_prefix(held, "e")).cast("long").alias("with_e"),
    )


@query(
    CAPS
    + """, i AS (SELECT * FROM (VALUES ('tcp', ['join', 'elect', 'signal']), ('multi', ['join', 'leave', 'died', 'elect', 'signal']), ('nio', ['elect', 'signal'])) v(impl, offers)),
m AS (SELECT member, impl FROM c JOIN i ON list_has_all(offers, caps))
SELECT c.member, count(impl) AS n, CASE WHEN count(impl) = 0 THEN 'ERROR' WHEN count(impl) = 1 THEN min(impl) WHEN bool_or(impl = 'tcp') THEN 'tcp' ELSE 'AMBIGUOUS' END AS chosen FROM c LEFT JOIN m USING (member) GROUP BY c.member"""
)
def implementation_select(spark, d):
    # Three implementations with what they offer; the default is tcp.
    offers = {"tcp": ["join", "elect", "signal"], "multi": ["join", "leave", "died", "elect", "signal"], "nio": ["elect", "signal"]}
    caps = event_log(spark, d).groupBy("member").agg(S.capabilities(F.collect_set("kind")).alias("caps"))
    fits = F.array_compact(F.array(*[F.when(S.matches(F.col("caps"), F.array(*map(F.lit, o))), F.lit(i)) for i, o in offers.items()]))
    n = F.size(fits)
    chosen = F.when(n == 0, "ERROR").when(n == 1, F.get(fits, F.lit(0))).when(F.array_contains(fits, "tcp"), "tcp").otherwise("AMBIGUOUS")
    return caps.select("member", n.cast("long").alias("n"), chosen.alias("chosen"))


VEC = "e AS (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS a FROM embeddings), p AS (SELECT vec_id, a, lead(a) OVER (PARTITION BY vec_id % 8 ORDER BY vec_id) AS b FROM e), q AS (SELECT vec_id, a, b, sqrt((a[1]-b[1])*(a[1]-b[1]) + (a[2]-b[2])*(a[2]-b[2]) + (a[3]-b[3])*(a[3]-b[3])) AS gap FROM p WHERE b IS NOT NULL)"


def _coordinates(spark, d):
    first = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    points = read(spark, d, "embeddings").select("vec_id", first.alias("a"))
    return ordered.neighbour(points.withColumn("ring", F.col("vec_id") % 8), ["ring"], ["vec_id"], "a", "b", 1).filter("b is not null")


@query(f"WITH {VEC} SELECT vec_id, round(gap, 9) AS distance, round(sqrt(a[1]*a[1] + a[2]*a[2] + a[3]*a[3]), 9) AS magnitude FROM q")
def vivaldi_distance(spark, d):
    return _coordinates(spark, d).select("vec_id", F.round(S.distance(F.col("a"), F.col("b")), 9).alias("distance"), F.round(S.magnitude(F.col("a")), 9).alias("magnitude"))


@query(f"WITH {VEC} SELECT vec_id, round(a[1] + (a[1] - b[1]) * CASE WHEN gap < 0.01 THEN 0 ELSE 0.1 * 0.5 * (0.25 - gap) / gap END, 9) AS x, round(least(1.0, abs(gap - 0.25) / 0.25 * 0.1 * 0.5 + 0.5 * (1 - 0.5 * 0.1)), 9) AS error FROM q")
def vivaldi_update_step(spark, d):
    moved, error = S.coordinate_step(F.col("a"), F.lit(0.5), F.col("b"), F.lit(0.5), F.lit(0.25))
    return _coordinates(spark, d).select("vec_id", F.round(F.get(moved, F.lit(0)), 9).alias("x"), F.round(error, 9).alias("error"))


@query("SELECT a.c_custkey, levenshtein(a.c_name, b.p_name) AS edits, coalesce(list_position(list_transform(range(1, least(length(a.c_name), length(b.p_name)) + 1), lambda i: a.c_name[i] <> b.p_name[i]), true) - 1, least(length(a.c_name), length(b.p_name)))::BIGINT AS prefix FROM customer a JOIN part b ON a.c_custkey = b.p_partkey")
def edit_distance(spark, d):
    pairs = read(spark, d, "customer").join(read(spark, d, "part"), F.col("c_custkey") == F.col("p_partkey"))
    return pairs.select("c_custkey", F.levenshtein("c_name", "p_name").cast("long").alias("edits"), S.common_prefix(F.col("c_name"), F.col("p_name")).alias("prefix"))


@query(
    BASE
    + """, t AS (SELECT event_id, k || CASE k % 4 WHEN 0 THEN 'k' WHEN 1 THEN 'M' WHEN 2 THEN '' ELSE 'T' END AS raw, CASE k % 3 WHEN 0 THEN 'on' WHEN 1 THEN 'false' END AS flag, CASE k % 2 WHEN 0 THEN k::VARCHAR ELSE 'x' || k END AS num FROM log)
SELECT event_id, CASE right(raw, 1) WHEN 'k' THEN rtrim(raw, 'k')::BIGINT * 1024 WHEN 'M' THEN rtrim(raw, 'M')::BIGINT * 1048576 WHEN 'T' THEN NULL ELSE raw::BIGINT END AS size, coalesce(flag IN ('1', 'on', '', 'true', 'yes'), true) AS flag, coalesce(try_cast(num AS BIGINT), -1) AS num FROM t"""
)
def typed_properties(spark, d):
    k = F.col("k")
    raw = F.concat(k.cast("string"), F.element_at(F.array(*map(F.lit, ("k", "M", "", "T"))), (k % 4 + 1).cast("int")))
    flag = F.when(k % 3 == 0, "on").when(k % 3 == 1, "false")
    number = F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit("x"), k.cast("string")))
    return event_log(spark, d).select("event_id", S.size_literal(raw).alias("size"), S.boolean_literal(flag, True).alias("flag"), F.coalesce(number.try_cast("long"), F.lit(-1)).alias("num"))


@query(BASE + ", l AS (SELECT member, k AS layer, name AS key, event_id FROM log WHERE kind = 'SIGNAL') SELECT member, key, arg_max(event_id, (layer, event_id)) AS value FROM l GROUP BY ALL")
def layered_properties(spark, d):
    layered = event_log(spark, d).filter("kind = 'SIGNAL'")
    return layered.groupBy("member", F.col("name").alias("key")).agg(F.max_by("event_id", F.struct("k", "event_id")).alias("value"))


@query(
    BASE
    + """, a AS (SELECT event_id, pool, CASE k % 4 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '127.0.0.' WHEN 2 THEN '169.254.0.' ELSE '8.8.4.' END || k AS address, CASE k % 4 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 2 END AS score FROM log)
SELECT pool, address, score::BIGINT AS score, row_number() OVER (PARTITION BY pool ORDER BY score, length(address), address) AS place FROM (SELECT DISTINCT pool, address, score FROM a)"""
)
def address_preference(spark, d):
    k = F.col("k")
    prefix = F.element_at(F.array(*map(F.lit, ("10.0.0.", "127.0.0.", "169.254.0.", "8.8.4."))), (k % 4 + 1).cast("int"))
    found = event_log(spark, d).select("pool", F.concat(prefix, k.cast("string")).alias("address")).distinct().withColumn("score", S.address_score(F.col("address")))
    placed = ordered.ranked(found.withColumn("n", F.length("address")), ["pool"], ["score", "n", "address"], "place")
    return placed.select("pool", "address", "score", (F.col("place") + 1).alias("place"))


@query(BASE + "SELECT event_id, value, CASE WHEN value < 1 THEN printf('%.3f', value * 1e3) || ' ns' WHEN value < 1e3 THEN printf('%.3f', value) || ' us' WHEN value < 1e6 THEN printf('%.3f', value / 1e3) || ' ms' ELSE printf('%.3f', value / 1e6) || ' s' END AS shown FROM log")
def duration_format(spark, d):
    return event_log(spark, d).select("event_id", "value", S.duration(F.col("value")).alias("shown"))


@query("SELECT doc_id, length(text) AS chars, strlen(text) AS utf8, md5(text) AS digest FROM documents")
def codec_roundtrip(spark, d):
    coded = read(spark, d, "documents").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("wire"))
    back = F.decode(F.unbase64("wire"), "UTF-8")
    return coded.select("doc_id", F.length(back).cast("long").alias("chars"), F.octet_length(back).cast("long").alias("utf8"), F.md5(back.cast("binary")).alias("digest"))
