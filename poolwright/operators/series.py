"""Step functions over time: as-of values on grids, averages, and measured statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.operators import ordered


def grid(bounds: DataFrame, points: int = 100) -> DataFrame:
    """(key columns, t): from 0 to duration + 2 steps, a step being max(1, duration / points). bounds has duration."""
    step = F.greatest(F.lit(1), F.floor(F.col("duration") / points)).cast("long")
    return bounds.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("duration") + 2 * step, step)))


def as_of(probes: DataFrame, series: DataFrame, key: str, time: str = "t", value: str = "value") -> DataFrame:
    """probes with the series' last value at or before their time; -1 before the first point and from the last point on, where it is unknown.

    Probes and points are put in one line, and the last point before each probe is carried along.
    """
    points = series.select(key, time, F.col(value).cast("long").alias("_v"), F.lit(0).alias("_probe"))
    asked = probes.select(key, time, F.lit(None).cast("long").alias("_v"), F.lit(1).alias("_probe"))
    line = ordered.carried(points.unionByName(asked), [key], [time, "_probe"], "_v", "_last").filter("_probe = 1")
    line = line.join(series.groupBy(key).agg(F.max(time).alias("_end")), key, "left")
    known = F.col("_last").isNotNull() & (F.col(time) < F.col("_end"))
    return line.select(key, time, F.when(known, F.col("_last")).otherwise(-1).cast("long").alias("value"))


def mean_known(values: DataFrame, by: str) -> DataFrame:
    """Mean of the values other than -1 by time; 0 if there are none."""
    return values.groupBy(by).agg(F.coalesce(F.avg(F.when(F.col("value") != -1, F.col("value").cast("double"))), F.lit(0.0)).alias("mean"))


def ceil2(x: Column) -> Column:
    """Rounded up to two decimals."""
    return F.ceil(x * 100).cast("double") / 100


def megabytes_per_second(size: Column, millis: Column) -> Column:
    return ceil2(size / millis * 1000.0 / 1048576.0)


def spread(x: Column) -> tuple[Column, Column, Column]:
    """Mean, sample deviation (0 for one value) and relative error in percent (0 for mean 0)."""
    mean, deviation = F.coalesce(F.avg(x), F.lit(0.0)), F.coalesce(F.stddev_samp(x), F.lit(0.0))
    return mean, deviation, F.when(mean == 0, 0.0).otherwise(F.floor(deviation / mean * 100 + 0.5).cast("double"))
