"""Hand-computed cases: admission, order over partitions, late rows, damaged files, templates, ring order, edit distance, sequences."""

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from poolwright.functions import scalars as S
from poolwright.operators import channel as C
from poolwright.operators import merge, ordered, service
from poolwright.operators import log as L
from tests.test_operators import got, log, one


def test_admission_counts_connections_not_requests(spark):
    ports = spark.createDataFrame([(1, 0, True, False), (2, 0, True, True), (3, 0, False, True)], "port long, type long, enabled boolean, many boolean")
    asked = [
        (1, 1, 7, 9, True), (1, 2, 8, 0, False), (1, 3, 7, 0, True), (1, 4, 7, 0, True), (1, 5, 8, 0, True), (1, 6, 8, 0, False), (1, 7, 9, 9, True),
        (2, 1, 7, 0, True), (2, 2, 8, 0, True), (2, 3, 9, 0, False), (2, 4, 9, 0, True), (2, 5, 9, 9, True), (3, 1, 7, 0, True), (4, 1, 7, 0, True),
    ]
    requests = spark.createDataFrame(asked, "port long, seq long, sender long, type long, granted boolean")
    assert [r[2] for r in got(C.admit(requests, ports), "port", "seq", "outcome")] == [
        "TYPE_MISMATCH", "DENIED", "ACCEPTED", "ALREADY_CONNECTED", "NO_MANY_TO_X", "NO_MANY_TO_X", "TYPE_MISMATCH",
        "ACCEPTED", "ACCEPTED", "DENIED", "ACCEPTED", "ALREADY_CONNECTED", "DISABLED", "NOT_PRESENT",
    ]


@pytest.fixture(scope="module")
def one_key(spark):
    """One key of all rows but two, in shuffled order over many partitions; every seventh value is null."""
    rows = [(1, i, None if i % 7 == 3 else i % 5 - 2) for i in range(500)] + [(None, 0, 4), (2, 0, None)]
    return rows, spark.createDataFrame(rows, "k long, t long, v long").repartition(9, F.hash("t"))


def test_order_within_a_key_of_all_rows(spark, one_key):
    rows, frame = one_key
    main = [r for r in rows if r[0] == 1]
    assert got(ordered.ranked(frame, ["k"], ["t"], "r").filter("k = 1"), "t", "r") == [(i, i) for i in range(500)]
    assert ordered.ranked(frame, ["k"], ["t"], "r").filter("k is null").first()["r"] == 0
    total, low, sums = 0, 10**9, []
    for _, t, v in main:
        total += v or 0
        low = min(low, total)
        sums.append((t, total, low))
    assert got(ordered.running(frame, ["k"], ["t"], F.coalesce("v", F.lit(0)), "s", low="m").filter("k = 1"), "t", "s", "m") == sums
    before = {t: r["b"] for t, r in ((r["t"], r) for r in ordered.neighbour(frame, ["k"], ["t"], "v", "b", -1).filter("k = 1").collect())}
    assert before == {i: main[i - 1][2] if i else None for i in range(500)}
    after = {r["t"]: r["b"] for r in ordered.neighbour(frame, ["k"], ["t"], "v", "b", 1).filter("k = 1").collect()}
    assert after == {i: main[i + 1][2] if i < 499 else None for i in range(500)}
    held, carried = None, {}
    for _, t, v in main:
        held = held if v is None else v
        carried[t] = held
    assert {r["t"]: r["c"] for r in ordered.carried(frame, ["k"], ["t"], "v", "c").filter("k = 1").collect()} == carried


def test_one_pool_is_spread_over_partitions(spark):
    events = spark.range(4000).select(F.lit(1).alias("pool"), F.col("id").alias("event_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be put together
    try:
        placed = ordered.laid_out(events, ["pool"], ["event_id"])
        sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * min(sizes)
    plan = L.clock(events)._jdf.queryExecution().optimizedPlan().toString()
    assert "event_id" not in "".join(line for line in plan.splitlines() if "Window" in line)


def test_empty_tables_keep_their_columns(spark):
    nothing = spark.createDataFrame([], "pool long, time long, kind string, member long, name long")
    assert ordered.ranked(nothing, ["pool"], ["time"], "r").count() == 0
    assert L.size_history(nothing).columns == ["pool", "time", "size"] and L.size_history(nothing).count() == 0


def test_late_rows_are_dropped_and_windows_written_once(spark, tmp_path):
    from poolwright.streaming import membership as M

    day = lambda n: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=n)
    batches = [[(day(0), "a"), (day(1), "a"), (day(9), "a")], [(day(10), "b")], [(day(1), "a"), (day(9), "b"), (day(20), "b")]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "ts timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / f"in/batch={k}"))
        for file in (tmp_path / f"in/batch={k}").glob("*.parquet"):
            os.utime(file, (1_700_000_000 + 10 * k,) * 2)
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    shown = lambda frame: sorted((r["w"]["start"].timestamp() // 86400 - day(0).timestamp() // 86400, r["kind"], r["n"]) for r in frame.collect())
    # The third batch's row of day 1 is late: the first batch has moved the watermark to day 8. That of day 9 is not.
    assert shown(M.drain(spark, M.tumbling_counts(stream))) == [(0, "a", 1), (1, "a", 1), (9, "a", 1), (9, "b", 1), (10, "b", 1)]
    assert shown(M.drain(spark, M.sliding_counts(stream))) == [(-1, "a", 1), (0, "a", 2), (1, "a", 1), (8, "a", 1), (8, "b", 1), (9, "a", 1), (9, "b", 2), (10, "b", 1)]


def test_a_damaged_version_gives_way_as_a_whole(spark, tmp_path):
    from poolwright.sources import statistics as T

    path = str(tmp_path / "s")
    series = lambda n: spark.createDataFrame([(f"m{i}", "size", i, n, p) for i in range(40) for p in (1, 2)], T.SERIES).repartition(3)
    T.write_snapshot(series(1), path, 1)
    T.write_snapshot(series(2), path, 2)
    values = lambda: {r["pool"]: (r["low"], r["high"], r["n"]) for r in T.read_experiment(spark, path).groupBy("pool").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")).collect()}
    assert values() == {1: (2, 2, 40), 2: (2, 2, 40)}
    damaged = sorted(Path(path, "rows", "version=00000002", "pool=1").glob("*.parquet"))
    assert len(damaged) == 3
    damaged[0].write_bytes(b"PAR1 not a file")
    damaged[0].with_name(f".{damaged[0].name}.crc").unlink(missing_ok=True)
    assert values() == {1: (1, 1, 40), 2: (2, 2, 40)}


def test_templates_lists_and_bytes(spark):
    fill = lambda text: one(spark, S.filled(F.lit(text), F.lit("node3.cs.vu.nl"), F.lit(9)))
    assert fill("%HOSTNAME%@%DOMAIN%") == "node3@cs@vu@nl" and fill("%FLAT_DOMAIN%") == "cs:vu:nl" and fill("50%%@%NOT%@%") == "50%@%NOT%@%"
    assert one(spark, S.expanded(F.lit("${A}-${B}-${C}$"), {"A": "<${B}>", "B": "b"})) == "<b>-b-${C}$"
    lists = lambda text: one(spark, S.string_list(F.lit(text).cast("string")))
    assert lists("a , b,,c,,") == ["a", "b", "", "c"] and lists("") == [""] and lists(None) == [] and lists(",,") == []
    assert one(spark, S.big_endian(F.lit(-2))) == "FFFFFFFFFFFFFFFE" and one(spark, S.little_endian(F.lit(258), 4)) == "02010000"
    assert one(spark, S.from_big_endian(F.lit("FFFFFFFFFFFFFFFE"))) == -2 and one(spark, S.from_big_endian(F.lit("0000000000000102"))) == 258
    assert one(spark, S.wire_length(F.lit("a\x00é☃\U0001f600"))) == 1 + 2 + 2 + 3 + 6


def test_ring_order_edit_distance_sequences_and_gossip(spark):
    pairs = spark.createDataFrame([("kitten", "sitting"), ("", "abc"), ("same", "same")], "a string, b string")
    assert [tuple(r) for r in pairs.select(F.levenshtein("a", "b"), S.common_prefix(F.col("a"), F.col("b"))).collect()] == [(3, 0), (3, 0), (0, 4)]
    counted = log(spark, ("SIGNAL", 1, 5), ("SIGNAL", 1, 6), ("SIGNAL", 2, 5))
    assert got(L.numbered(counted, ["name"], "time"), "time", "number") == [(0, 0), (1, 0), (2, 1)]
    victims = service.victims(spark.createDataFrame([(1, m) for m in range(5)] + [(2, 0), (2, 1)], "pool long, member long"), "s")
    assert all(r["victim"] != r["member"] for r in victims.collect()) and victims.count() == 7
    seen = spark.createDataFrame([(1, 10, 1, False, False), (1, 20, 2, False, False), (2, 5, 1, False, True), (2, 9, 3, True, False)], "id long, last_seen long, witness long, dead boolean, left boolean")
    merged = merge.merge_members(seen.unionByName(seen), now=25, timeout=100, required=5)
    assert got(merged, "id", "last_seen", "witnesses", "dead", "left", "live") == [(1, 20, 2, False, False, True), (2, 9, 0, True, True, False)]


def test_coordinates_that_coincide_push_each_other_off(spark):
    measured = spark.createDataFrame([(1, 1, 0.5, 0.0, 0.0, 0.5)], "member long, event_id long, rtt double, x double, y double, error double")
    still = service.tracked(measured, "member", "event_id", push=False).first()
    away = service.tracked(measured, "member", "event_id").first()
    assert (still["x"], still["y"]) == (0, 0) and abs((away["x"] ** 2 + away["y"] ** 2) ** 0.5 - 0.1 * (1 / 1.5) * 0.5) < 1e-12
