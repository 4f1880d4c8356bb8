"""Channels between ports: admission, fan-in and fan-out, replies, routing, fragments, connection state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from poolwright.operators import ordered


def admit(requests: DataFrame, ports: DataFrame) -> DataFrame:
    """Outcome of each request (port, seq, sender, type, granted) against its port (port, type, enabled, many): the first rule that applies.

    Only an accepted request makes a connection. granted is what the port's owner says when asked, which is the last rule. As nothing is closed here, the first
    request that no earlier connection can stand against is the one accepted: of its sender, or of the whole port where it takes one connection only.
    """
    both = requests.withColumnRenamed("type", "asked").join(ports, "port", "left")
    fits = F.coalesce((F.col("asked") == F.col("type")) & F.col("enabled") & F.col("granted"), F.lit(False))
    both = both.withColumn("fit", F.when(fits, F.col("seq")))
    of_sender = both.groupBy("port", "sender").agg(F.min("fit").alias("since"))
    of_port = both.groupBy("port").agg(F.min("fit").alias("taken"))
    both = both.join(of_sender, ["port", "sender"]).join(of_port, "port")
    connected = F.when(F.col("many") | (F.col("since") == F.col("taken")), F.col("since"))
    outcome = (
        F.when(F.col("enabled").isNull(), "NOT_PRESENT")
        .when(F.col("seq") > connected, "ALREADY_CONNECTED")
        .when(F.col("asked") != F.col("type"), "TYPE_MISMATCH")
        .when(~F.col("enabled"), "DISABLED")
        .when(~F.col("many") & (F.col("seq") > F.col("taken")), "NO_MANY_TO_X")
        .when(~F.col("granted"), "DENIED")
        .otherwise("ACCEPTED")
    )
    return both.select("port", "seq", "sender", outcome.alias("outcome"))


def connected_to(steps: DataFrame) -> DataFrame:
    """(a, peers): to how many each a is connected after connect (1) and disconnect (0) steps (a, b, time, on); none if it is connected to nobody."""
    last = steps.groupBy("a", "b").agg(F.max_by("on", "time").alias("on"))
    return last.groupBy("a").agg(F.count_if(F.col("on") == 1).alias("peers"))


def round_robin(messages: DataFrame, port: str, sender: str, order: str) -> DataFrame:
    """Delivery order at a port that takes one message of each sender in turn; within a sender the order of sending holds."""
    turn = F.row_number().over(W.partitionBy(port, sender).orderBy(order))
    return ordered.ranked(messages.withColumn("_turn", turn), [port], ["_turn", sender], "delivery").drop("_turn")


def fragments(texts: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, num, last, part): each text cut to parts of size characters, at least one."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    cut = texts.select(key, F.col(text).alias("_t"), n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("num"))
    return cut.select(key, "num", (F.col("num") == F.col("_n") - 1).alias("last"), F.substring("_t", F.col("num") * size + 1, F.lit(size)).alias("part"))


def reassemble(packets: DataFrame, key: str) -> DataFrame:
    """(key, packets, text) of complete series: 0 to the last without a gap. An incomplete series gives nothing."""
    series = packets.groupBy(key).agg(
        F.count(F.lit(1)).alias("packets"),
        F.max(F.when(F.col("last"), F.col("num"))).alias("top"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("num", "part"))), lambda x: x["part"]), "").alias("text"),
    )
    return series.filter("top is not null and packets = top + 1").select(key, F.col("packets").cast("long").alias("packets"), "text")


def live_at(log: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (pool, member, time) at which the member was in its pool: the last transition before the probe is a join."""
    w = W.partitionBy("pool", "member").orderBy("time", "_probe").rowsBetween(W.unboundedPreceding, 0)
    extra = [c for c in probes.columns if c not in ("pool", "member", "time")]
    moves = log.select("pool", "member", "time", "delta", F.lit(0).alias("_probe"), *[F.lit(None).cast(dict(probes.dtypes)[c]).alias(c) for c in extra])
    asked = probes.withColumns({"delta": F.lit(None).cast("long"), "_probe": F.lit(1)})
    line = moves.unionByName(asked).withColumn("state", F.last("delta", ignorenulls=True).over(w))
    return line.filter("_probe = 1 and state = 1").select(*probes.columns)


def first_living(candidates: DataFrame, living: DataFrame) -> DataFrame:
    """(request, chosen): the first candidate by pos that is living; the first one if none is."""
    marked = candidates.join(living.select("member").distinct().withColumn("alive", F.lit(1)), "member", "left")
    alive = F.min(F.when(F.col("alive") == 1, F.struct("pos", "member"))).alias("alive")
    return marked.groupBy("request").agg(alive, F.min(F.struct("pos", "member")).alias("any")).select("request", F.coalesce("alive.member", "any.member").alias("chosen"))


def lifecycle(log: DataFrame) -> DataFrame:
    """Outcome of connect (1) and disconnect (0) steps (a, b, time, on): a repeat changes nothing."""
    before = F.coalesce(F.lag("on").over(W.partitionBy("a", "b").orderBy("time")), F.lit(0))
    outcome = (
        F.when((F.col("on") == 1) & (before == 1), "ALREADY_CONNECTED").when((F.col("on") == 0) & (before == 0), "NOT_CONNECTED").when(F.col("on") == 1, "CONNECTED").otherwise("DISCONNECTED")
    )
    return log.withColumn("outcome", outcome)


def in_units(bits: Column) -> Column:
    """Rate as text: Mbit above a million, else Kbit."""
    return F.when(bits > 1e6, F.concat(F.format_string("%.2f", bits / 1e6), F.lit(" Mbit/s"))).otherwise(F.concat(F.format_string("%.2f", bits / 1e3), F.lit(" Kbit/s")))
