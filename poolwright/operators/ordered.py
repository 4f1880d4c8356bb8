"""Ranks, running sums, neighbours and carried values in the order of a few large keys.

A window over few keys puts each key's rows in one task. Here rows are range-partitioned by keys and order instead, so a key of any size is spread over as
many partitions as there are; each partition is worked on by itself, and what a partition needs of those before it (a count, a sum, a last value) comes
from a table of one row for each key and partition. Rows of equal order are put in some order, so orders should be unique within a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from poolwright.scratch import written


def laid_out(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df in order, written: _part (range partition) and _at (place in it)."""
    cols = [*keys, *order]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    return written(placed.withColumn("_part", F.shiftright("_at", 33)), "ordered")


def _parts(placed: DataFrame, keys: list[str], **figures: Column) -> DataFrame:
    """One row for each key and partition that has any of its rows."""
    return placed.groupBy(*keys, "_part").agg(*[v.alias(k) for k, v in figures.items()])


def _earlier(keys: list[str], last: int = -1) -> W:
    return W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, last)


def _with(placed: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """placed beside its partition's figures; null keys meet null ones."""
    own = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_part"])], *[c for c in parts.columns if c not in (*keys, "_part")])
    on = reduce(lambda a, b: a & b, [placed[k].eqNullSafe(own[f"_k{i}"]) for i, k in enumerate([*keys, "_part"])])
    return placed.join(own, on).drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Ranks from 0 within keys. No window reads the rows: a row's rank is its place less its key's first place, and the rows before its partition."""
    placed = laid_out(df, keys, order)
    parts = _parts(placed, keys, _first=F.min("_at"), _n=F.count(F.lit(1)))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)) - F.col("_first")).drop("_first", "_n")
    return _with(placed, parts, keys).withColumn(name, F.col("_before") + F.col("_at")).drop("_before", "_at", "_part")


def _inside(keys: list[str]) -> W:
    return W.partitionBy(*keys, "_part").orderBy("_at")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, low: str | None = None) -> DataFrame:
    """Running sum of value, and as column low (if named) the least running sum so far."""
    placed = laid_out(df.withColumn("_value", value.cast("long")), keys, order)
    upto = _inside(keys).rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("_sum", F.sum("_value").over(upto)).withColumn("_low", F.min("_sum").over(upto))
    parts = _parts(placed, keys, _total=F.sum("_value"), _least=F.min("_sum"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_total").over(_earlier(keys)), F.lit(0)))
    parts = parts.withColumn("_lowest", F.min(F.col("_before") + F.col("_least")).over(_earlier(keys))).drop("_total", "_least")
    out = _with(placed, parts, keys).withColumn(name, F.col("_before") + F.col("_sum"))
    if low:
        out = out.withColumn(low, F.least("_lowest", F.col("_before") + F.col("_low")))
    return out.drop("_value", "_sum", "_low", "_before", "_lowest", "_at", "_part")


def neighbour(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, step: int) -> DataFrame:
    """The value of the row before (step -1) or after (1) within keys; null for the first or last."""
    placed = laid_out(df, keys, order)
    edge = F.max_by if step < 0 else F.min_by
    parts = _parts(placed, keys, _edge=F.struct(edge(value, "_at").alias("v")), _first=F.min("_at"), _last=F.max("_at"))
    line = W.partitionBy(*keys).orderBy("_part")
    parts = parts.withColumn("_edge", (F.lag if step < 0 else F.lead)("_edge").over(line))
    inside = (F.lag if step < 0 else F.lead)(value).over(_inside(keys))
    out = _with(placed.withColumn("_near", inside), parts, keys)
    at_edge = F.col("_at") == F.col("_first" if step < 0 else "_last")
    return out.withColumn(name, F.when(at_edge, F.col("_edge.v")).otherwise(F.col("_near"))).drop("_near", "_edge", "_first", "_last", "_at", "_part")


def carried(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last value that is not null, at or before each row."""
    placed = laid_out(df, keys, order)
    held = F.last(value, ignorenulls=True)
    parts = _parts(placed, keys, _held=F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))))
    parts = parts.withColumn("_held", F.last("_held", ignorenulls=True).over(_earlier(keys)))
    inside = held.over(_inside(keys).rowsBetween(W.unboundedPreceding, 0))
    out = _with(placed.withColumn("_near", inside), parts, keys)
    return out.withColumn(name, F.coalesce("_near", "_held")).drop("_near", "_held", "_at", "_part")
