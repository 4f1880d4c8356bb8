"""What the training-data operators share: scratch tables, safe column names, ASCII text rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a longest run of anything but ASCII white space.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names not in df, whatever columns its owner added."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words (null: 0), counted without building an array of them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_matching(docs: DataFrame, kept: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key is in kept (unique keys, null matching null); docs' columns only.

    The keys are the small side and build the hash table of each partition, so texts are shuffled once and never sorted.
    """
    (name,) = fresh(docs, "_kept_key")
    keys = kept.select(F.col(key).alias(name))
    return docs.join(keys.hint("shuffle_hash"), docs[key].eqNullSafe(keys[name]), "left_semi")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, however often later steps name it: a generator keeps Catalyst from inlining it."""
    return df.select("*", F.explode(F.array(value)).alias(name))
