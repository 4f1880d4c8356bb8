"""From raw documents to sampled token sequences: quality filter, exact dedup, near dedup, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from poolwright.llm import exact_dedup, minhash_dedup, mixing, quality, sentencepiece_codec
from poolwright.llm.common import scratch, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1. It learns from sf_dir's labels, as operator 8 does."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id."""
    return exact_dedup.dedup_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest doc_id."""
    return minhash_dedup.dedup_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none, once or twice."""
    return mixing.mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each row's text. A document that the mix took twice is encoded twice, alike, as its key is the seed."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("source mix", source_mix),
    ("SentencePiece encoding", encoding),
]

#: SQL can't express the classifier, the sketches and the sampling; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch(docs, f"stage-{k}")
    return docs
