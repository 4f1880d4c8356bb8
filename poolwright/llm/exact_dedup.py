"""Exact dedup against a persistent digest index, bucketed and sorted by digest.

The index is a Parquet table clustered and sorted by digest. A batch is reduced to one row per digest, anti-joined with the index by a
sort-merge join that leaves the index where it lies, and what is new is appended. Texts never enter the index or its joins.

Defined cases: a null text is the empty text; texts are equal when identical after lower-casing A-Z; of equal texts in one batch the row
with the largest doc_id stays; a text that the index has from an earlier batch drops all its rows; a null doc_id counts as smaller than any other; of rows
that repeat both doc_id and text one stays; an empty table gives an empty result; further columns pass through stages untouched.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.llm.common import ascii_lower, fresh, scratch, scratch_path

#: A digest that holds over 1/HOT of a batch's rows is joined by broadcast; there are fewer than HOT of them.
HOT = 1000


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256))


class DigestIndex:
    """Digests seen so far: (digest, keep_id, group_size, batch), bucketed and sorted by digest under one path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Groups whose digest the index lacks. Groups are written first: Catalyst would push the anti-join below their aggregation, where a frequent digest's rows all meet."""
        return scratch(groups, "digest-groups").join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the groups whose digest no earlier batch has. A batch that was appended before is left as it is, so a rerun is harmless."""
        index = self.table()
        if index.filter(F.col("batch") == batch).limit(1).count():
            return
        new = self.unseen(groups)
        new = new.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"))
        # One file per bucket: the exchange hashes as the buckets do.
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def decide(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Add docs to the index and say for each row whether it stays: doc_id, keep_id, group_size, kept, digest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
    rows = scratch(rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "digests")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    index.add(groups, batch)
    known = index.table()
    # Digests of very many rows would meet in one task of the join; fewer than HOT can be that frequent, so these few are sent to the rows.
    total = rows.agg(F.sum("copies")).first()[0] or 0
    frequent = F.broadcast(groups.filter(F.col("group_size") > max(total // HOT, HOT)).select("digest"))
    hot_rows = rows.join(F.broadcast(known.join(frequent, "digest", "left_semi")), "digest")
    rest = rows.join(frequent, "digest", "left_anti").join(known.hint("merge"), "digest")
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    found = hot_rows.unionByName(rest).select("*", copy)
    kept = (F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder, for a corpus deduplicated by itself."""
    return DigestIndex(spark, scratch_path(spark, "digest-index"))


def dedup_documents(docs: DataFrame, index: DigestIndex | None = None, batch: str = "batch") -> DataFrame:
    """Rows of docs that stay, with docs' columns."""
    index = index or new_index(docs.sparkSession)
    stays = decide(docs, index, batch).filter("kept")
    key, hash_, n = fresh(docs, "_dedup_id", "_dedup_digest", "_dedup_copy")
    stays = stays.select(F.col("doc_id").alias(key), F.col("digest").alias(hash_))
    tagged = docs.withColumn(hash_, digest(docs["text"]))
    on = tagged["doc_id"].cast("long").eqNullSafe(stays[key]) & (tagged[hash_] == stays[hash_])
    out = tagged.join(stays.hint("shuffle_hash"), on, "left_semi")
    # Rows that repeat both doc_id and digest land beside each other; all but one go.
    return out.dropDuplicates(["doc_id", hash_]).drop(hash_) if _repeats(docs) else out.drop(hash_)


def _repeats(docs: DataFrame) -> bool:
    """Whether some doc_id is on several rows."""
    return bool(docs.groupBy("doc_id").count().filter("count > 1").limit(1).count())
