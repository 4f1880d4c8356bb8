"""Hand-computed cases of the operators."""

from pyspark.sql import functions as F

from poolwright.functions import scalars as S
from poolwright.operators import channel as C
from poolwright.operators import log as L
from poolwright.operators import merge, series


def log(spark, *events):
    return spark.createDataFrame([(1, t, kind, member, name) for t, (kind, member, name) in enumerate(events)], "pool long, time long, kind string, member long, name long")


def got(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_leave_of_a_stranger_is_no_event(spark):
    events = log(spark, ("LEAVE", 1, 0), ("JOIN", 1, 0), ("JOIN", 1, 0), ("DIED", 1, 0), ("LEAVE", 1, 0))
    assert got(L.transitions(events), "time", "delta") == [(1, 1), (3, -1)]
    assert got(L.size_history(events), "time", "size") == [(1, 1), (3, 0)]


def test_as_of_is_unknown_before_the_first_and_from_the_last_point(spark):
    points = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "pool long, t long, value long")
    probes = spark.createDataFrame([(1, t) for t in (5, 10, 19, 20, 25)], "pool long, t long")
    assert got(series.as_of(probes, points, "pool"), "t", "value") == [(5, -1), (10, 1), (19, 1), (20, -1), (25, -1)]


def test_range_stops_at_the_first_gap(spark):
    events = spark.createDataFrame([(1, t) for t in (3, 4, 6, 7)], "pool long, time long")
    assert got(L.contiguous(events, 3), "time") == [(3,), (4,)]
    assert got(L.contiguous(events, 5), "time") == [(6,), (7,)]
    assert got(L.next_required(spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "pool long, time long"), 0), "reached") == [(2,)]


def test_tokens_do_not_fall_below_nothing(spark):
    steps = spark.createDataFrame([(1, i, s) for i, s in enumerate((2, -1, -1, -1, 1))], "pool long, i long, step long")
    assert [b for _, b in got(L.balance(steps, ["pool"], "i", F.col("step")), "i", "balance")] == [2, 1, 0, 0, 1]


def test_an_election_reopens_when_its_winner_dies(spark):
    events = log(spark, ("JOIN", 1, 0), ("JOIN", 2, 0), ("ELECT", 1, 7), ("ELECT", 2, 7), ("DIED", 1, 0), ("ELECT", 1, 7), ("ELECT", 2, 7))
    assert got(L.elections(events), "name", "time", "winner", "lost_at") == [(7, 2, 1, 4), (7, 6, 2, None)]


def test_quorum_needs_more_than_the_required_witnesses(spark):
    rows = [("a", 0, w, False, False) for w in range(5)] + [("b", 0, w, False, False) for w in range(6)]
    merged = merge.merge_members(spark.createDataFrame(rows, "id string, last_seen long, witness long, dead boolean, left boolean"), now=100, timeout=10, required=5)
    assert got(merged, "id", "dead") == [("a", False), ("b", True)]


def test_fragments_need_every_packet(spark):
    packets = spark.createDataFrame([(1, 0, False, "a"), (1, 1, False, "b"), (1, 2, True, "c"), (2, 0, False, "a"), (2, 2, True, "c"), (3, 0, False, "x")], "k long, num int, last boolean, part string")
    assert got(C.reassemble(packets, "k"), "k", "text") == [(1, "abc")]


def test_locations(spark):
    a, b = S.levels(F.lit("n1@c1@s1")), S.levels(F.lit("n2@c1@s1"))
    assert one(spark, S.matching_levels(a, b)) == 2
    assert one(spark, S.render(S.parent(a))) == "c1@s1"
    assert one(spark, S.render(S.parent(S.levels(F.lit("x"))))) == ""
    assert one(spark, F.size(S.levels(F.lit("")))) == 0
    assert one(spark, S.levels(F.lit("a@b@@"))) == ["a", "b"]


def test_literals(spark):
    assert [one(spark, S.size_literal(F.lit(x))) for x in ("2k", "1M", "7", "1T")] == [2048, 1048576, 7, None]
    assert [one(spark, S.boolean_literal(F.lit(x).cast("string"), False)) for x in ("on", "", "no", None)] == [True, True, False, False]
    assert [one(spark, S.common_prefix(F.lit(x), F.lit(y))) for x, y in (("abc", "abd"), ("", "x"), ("ab", "abc"))] == [2, 0, 2]
    assert [one(spark, series.ceil2(F.lit(x))) for x in (1.001, -1.009)] == [1.01, -1.0]
    assert one(spark, S.align(F.lit(9), 8)) == 16


def test_spread_of_few_values(spark):
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "v double").agg(*[c.alias(n) for c, n in zip(series.spread(F.col("v")), "mde")]).first()
    assert tuple(frame()) == (0.0, 0.0, 0.0)
    assert tuple(frame(5.0))[:2] == (5.0, 0.0)
    assert abs(frame(1.0, 3.0)["d"] - 2**0.5) < 1e-12


def test_a_step_towards_a_closer_point(spark):
    moved, error = S.coordinate_step(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.lit(1.0), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.lit(1.0), F.lit(2.0))
    assert abs(one(spark, F.get(moved, F.lit(0))) - 1.05) < 1e-12 and one(spark, error) <= 1.0


def test_batch_and_stream_membership_agree(spark, data):
    from poolwright.plans.catalogue import QUERIES

    batch, stream = QUERIES["effective_membership"](spark, data), QUERIES["stream_membership"](spark, data)
    assert got(batch, "pool", "member", "kind", "delta") == got(stream, "pool", "member", "kind", "delta")


def test_statistics_files(spark, tmp_path):
    from poolwright.sources import statistics as T

    rows = [(1, "a", "size", t, v) for t, v in ((0, 1), (10, 2), (20, 3))] + [(2, "b", "size", 0, 7), (2, "b", "size", 40, 8)]
    first = spark.createDataFrame(rows, "pool long, id string, series string, t long, value long")
    T.write_snapshot(first, str(tmp_path / "s"), 1)
    T.write_snapshot(first.filter("pool = 1").withColumn("value", F.col("value") + 1), str(tmp_path / "s"), 2)
    back = T.read_experiment(spark, str(tmp_path / "s"))
    assert got(back, "pool", "t", "value") == [(1, 0, 2), (1, 10, 3), (1, 20, 4), (2, 0, 7), (2, 40, 8)]
    report = T.pool_size_report(back, points=4)
    assert dict(got(report, "t", "mean"))[0] == 4.5 and dict(got(report, "t", "mean"))[20] == 7.0
    T.write_report(report, str(tmp_path / "r"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "r")).count() == report.count()


def test_every_event_is_invoked(spark, tmp_path):
    from poolwright.plans.catalogue import QUERIES

    kinds, n = ["signup", "purchase", "view"], 4500
    rows = [(i, f"2024-01-01 00:00:{i % 60:02}", i % 7, kinds[i % 3], 1.0, f'{{"k": {i % 5}}}') for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    want = {i: [(True, k * k), (k > 0, 1000 // k if k else None), (False, None)][i % 3] for i in range(n) for k in [i % 5]}
    found = QUERIES["rpc_invoke"](spark, str(tmp_path)).collect()
    assert len(found) == n and {r["event_id"]: (r["ok"], r["result"]) for r in found} == want


def test_streams_leave_their_rows_in_files(spark, data):
    from poolwright.plans.catalogue import QUERIES

    for name in ("stream_membership", "stream_tumbling_counts", "stream_sliding_counts", "stream_heartbeat_sessions"):
        found = QUERIES[name](spark, data)
        assert found.inputFiles() and found.count() > 0
