"""Measured statistics as files: versioned snapshots by pool, experiments read back, and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.operators.series import as_of, grid, mean_known

SERIES = "id string, series string, t long, value long, pool long"


def write_snapshot(series: DataFrame, path: str, version: int) -> None:
    """Write (pool, id, series, t, value) as one version; earlier versions stay, and rerunning a version replaces it."""
    rows = series.select("id", "series", "t", "value", "pool")
    rows.write.mode("overwrite").partitionBy("pool").parquet(f"{path}/rows/version={version:08d}")
    rows.groupBy("pool").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts/version={version:08d}")


def read_experiment(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of each pool's statistics. A version with a damaged or missing file gives way to the one before it, as a whole.

    Every version ends with a row count by pool, written after its rows; rows are read past damage and counted, so what is lost shows.
    """
    every = spark.read.schema(f"{SERIES}, version int").option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.parquet").parquet(f"{path}/rows")
    counts = spark.read.schema("pool long, n long, version int").option("ignoreCorruptFiles", "true").parquet(f"{path}/counts")
    found = every.groupBy("pool", "version").agg(F.count(F.lit(1)).alias("n"))
    newest = found.join(counts, ["pool", "version", "n"]).groupBy("pool").agg(F.max("version").alias("version"))
    return every.join(newest, ["pool", "version"]).select("pool", "id", "series", "t", "value")


def pool_size_report(series: DataFrame, points: int = 100) -> DataFrame:
    """(t, pool size averaged over the series that know it), on a grid over the longest duration."""
    sizes = series.filter("series = 'size'").select("id", "t", "value")
    bounds = sizes.groupBy("id").agg(F.max("t").alias("duration"))
    return mean_known(as_of(grid(bounds, points).select("id", "t"), sizes, "id"), "t")


def write_report(report: DataFrame, path: str) -> None:
    """A report as tab-separated text, numbers with three decimals."""
    shown = [F.format_number(c, 3).alias(c) if kind == "double" else F.col(c) for c, kind in report.dtypes]
    report.select(*shown).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def traffic_report(traffic: DataFrame) -> DataFrame:
    """Mean of the clients' traffic in MiB and the server's, by pool, of rows (pool, id, server, bytes)."""
    each = traffic.groupBy("pool", "id").agg(F.max("server").alias("server"), (F.sum("bytes") / 1048576).alias("mib"))
    return each.groupBy("pool").agg(F.coalesce(F.avg(F.when(~F.col("server"), F.col("mib"))), F.lit(0.0)).alias("clients"), F.coalesce(F.sum(F.when(F.col("server"), F.col("mib"))), F.lit(0.0)).alias("server"))


def server_report(calls: DataFrame) -> DataFrame:
    """What the server did by pool and opcode, of rows (pool, opcode, millis, bytes): calls, their mean time and bytes."""
    return calls.groupBy("pool", "opcode").agg(F.count(F.lit(1)).alias("calls"), F.avg("millis").alias("mean_ms"), F.sum("bytes").alias("bytes"))
