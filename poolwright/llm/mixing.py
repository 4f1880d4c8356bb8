"""Mixing sources to target weights by systematic sampling.

A source's documents are put in order of size, each adds its expected copies (target size / source size) to a running sum, and a document
goes out once per integer that the sum plus one random offset of its source crosses. In order of size a source's taken words miss its
target by less than about its largest document. Ranks within a source come from range partitions, their totals and a prefix sum over those totals,
so no source is ever gathered in one task.

Defined cases: a null or empty text has size 0; sources go by code point with null last, '' and null being different sources; a source of
size 0 gets target 0; documents of equal size go by doc_id; rows that repeat a doc_id are drawn one by one, and the stage emits each of them as often
as the luckiest; a very long text is one row of its size, taken whole or not at all; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolwright.llm.common import fresh, scratch, word_count

WEIGHTS = (5, 2, 1)
RATIO = 1.5
CAP = 2.0
SEED = "mix-1"


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], tag: str) -> tuple[DataFrame, DataFrame]:
    """df with prefix sums (exclusive) of each of sums within keys, in order; and the totals by key and range partition.

    Two levels: rows are range-partitioned by keys and order, a window runs inside each (key, partition), and the partitions' totals,
    of which there are no more than partitions plus keys, get a prefix sum of their own. keys must not be null.
    """
    cols = [*keys, *order]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch(placed.withColumns({f"_v_{k}": v for k, v in sums.items()} | {"_part": F.shiftright("_at", 33)}), tag)
    parts = placed.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{k}").alias(f"_sum_{k}") for k in sums])
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", *[f"_sum_{k}" for k in sums], *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums])
    parts = scratch(parts, f"{tag}-parts")
    inside = W.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    rows = placed.withColumns({f"_in_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums})
    return rows, parts


def prefixed(rows: DataFrame, parts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Join what running() gave: column pre_<name> is the exclusive prefix sum."""
    out = rows.join(parts, [*keys, "_part"]) if keys else rows.join(parts, "_part")
    return out.withColumns({f"pre_{k}": F.col(f"_before_{k}") + F.col(f"_in_{k}") for k in names})


def offset(no_source: Column, source: Column, seed: str) -> Column:
    """A source's random offset in [0, 1): 20 bits of an MD5, so sums with a whole rate stay exact."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.when(no_source == 1, "null").otherwise(F.concat(F.lit("="), source))))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(1048576.0)


def targets(sources: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """Give each source (no_source, source, source_size) its target.

    Sources saturate in order of cap * size / weight. With all sources before one at their cap, the level is what is left over
    the weights that are left; the first source that this level doesn't fill fixes it for all.
    """
    ranked = prefixed(*running(sources, [], ["no_source", "source"], {"rank": F.lit(1)}, "mix-sources"), [], ["rank"])
    pick = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pre_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.select("no_source", "source", "source_size", pick.alias("weight"))
    ranked = ranked.withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    sums = {"size": F.col("source_size"), "weight": F.col("weight").cast("decimal(20,6)")}
    filled = prefixed(*running(ranked, [], ["full_at", "no_source", "source"], sums, "mix-levels"), [], ["size", "weight"])
    total = filled.agg(F.sum("source_size").cast("double").alias("size"), F.sum("weight").alias("weight")).first()
    size, weight = total["size"] or 0.0, total["weight"] or 1.0
    level = (F.lit(ratio * size) - cap * F.col("pre_size")) / (F.lit(weight) - F.col("pre_weight").cast("double"))
    open_ = filled.withColumn("level", level).filter("full_at > level").orderBy("full_at", "no_source", "source").select("level").first()
    capped = cap * F.col("source_size")
    target = F.least(capped, F.col("weight") * F.lit(open_["level"])) if open_ else capped
    return filled.select("no_source", "source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    rows = docs.select(
        "doc_id",
        F.col("source").isNull().cast("int").alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        word_count(F.col("text")).alias("size"),
    )
    keys = ["no_source", "source"]
    placed, parts = running(rows, keys, ["size", "doc_id"], {"docs": F.lit(1), "words": F.col("size")}, "mix-rows")
    sources = parts.groupBy(*keys).agg(F.sum("_sum_words").alias("source_size"))
    # A source's figures ride on its partitions' totals, so that a large source is joined part by part.
    parts = parts.drop("_sum_docs", "_sum_words", "_before_words").join(targets(scratch(sources, "mix-sizes"), weights, ratio, cap), keys)
    out = prefixed(placed.drop("_in_words"), parts, keys, ["docs"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset(F.col("no_source"), F.col("source"), seed)
    crossed = F.floor((F.col("pre_docs") + 1) * rate + u) - F.floor(F.col("pre_docs") * rate + u)
    copies = F.least(crossed, F.ceil(rate)).cast("long")
    out = out.select("doc_id", F.col("size"), "source_size", "target", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it; docs' columns."""
    key, n = fresh(docs, "_mix_id", "_mix_copies")
    copies = mix(docs, **options).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(n)).filter(F.col(n) > 0)
    out = docs.join(copies.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(copies[key])).drop(key)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop(n)
