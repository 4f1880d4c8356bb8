"""Connected components of an edge table by label propagation with pointer jumping, and blocks in which rows of different components meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has an edge; label: the smallest node of its component.

    Each round takes the least label among neighbours, then follows labels of labels, so a chain of n nodes needs about log n rounds.
    Every round ends in files; hubs are split by skew joins, as both sides of each join are plain scans. No edges, no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    both = scratch(both.filter("u <> v").distinct(), "cc-edges")
    labels = scratch(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "cc-labels")
    while True:
        offered = both.join(labels, both["u"] == labels["node"]).select(F.col("v").alias("node"), "label")
        old = labels.select("node", F.col("label").alias("old"))
        best = labels.unionByName(offered).groupBy("node").agg(F.min("label").alias("label"))
        best = scratch(best, "cc-best")
        further = best.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = best.join(further, "label").select("node", F.col("further").alias("label"))
        labels = scratch(jumped, "cc-labels")
        if not labels.join(old, "node").filter("label <> old").limit(1).count():
            return labels


def join_components(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """labels (node, label) of components() after further edges: only the components that these connect are looked at again."""
    ends = edges.select(F.explode(F.array(a, b)).alias("node")).distinct()
    known = scratch(labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))), "cc-known")
    of = lambda c: known.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    merged = components(edges.select(a, b).join(of(a), a).join(of(b), b), f"{a}_label", f"{b}_label")
    merged = merged.select(F.col("node").alias("label"), F.col("label").alias("merged"))
    return scratch(known.join(merged, "label", "left").select("node", F.coalesce("merged", "label").alias("label")), "cc-joined")


def meet_in_blocks(rows: DataFrame, keys: list[str], size: Column, block: int) -> DataFrame:
    """rows (with outside: whether it is out of its key's largest component), laid out so that each outside one (left) meets every other of its key in one block (i, j).

    Blocks have a tenth of the given size, so that several tasks share a key, or the given size where that would take more than 16 of them a side.
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / block), F.least(F.lit(16), F.ceil(10 * n / block))).cast("int")
    sizes = rows.groupBy(*keys).agg(blocks(F.sum(size)).alias("all"), blocks(F.sum(F.when(F.col("outside"), size).otherwise(0))).alias("out"))
    own = rows.join(scratch(sizes, "block-sizes"), keys)
    place = lambda n: F.pmod(F.hash("doc_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = own.filter("outside").withColumn("i", place("out")).withColumn("j", every("all")).withColumn("left", F.lit(True))
    right = own.withColumn("i", every("out")).withColumn("j", place("all")).withColumn("left", F.lit(False))
    return left.unionByName(right).drop("all", "out", "outside")
