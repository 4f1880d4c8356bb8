"""Cross-site boilerplate lines, found by their distinct-site spread, with DataFrame functions alone.

Lines are addressed by the MD5 of their trimmed, ASCII-lower-cased text. A first aggregate drops lines too rare, or too local, to reach the
threshold. What is left gets a HyperLogLog sketch of its sites per line, merged by aggregation. Estimates clearly above the threshold
decide; near it the exact number of sites does. Lines that reach min_sites leave every document.

Defined cases: a null text is the empty text; blank lines are never boilerplate; a null site counts as no site; a document's remaining lines keep their
order and their line feeds; a document of boilerplate alone becomes empty; repeated rows get equal results; very long texts are split whole, in one task each; an empty table
gives an empty result; further columns are ignored by the report and passed through by remove_boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import ascii_lower, fresh, scratch

MIN_SITES = 5
#: log2 of a sketch's buckets; its relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Estimates within so many standard errors (and one site) of the threshold are counted exactly.
NEAR = 4


def line_hash(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(ascii_lower(line)).cast("binary")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of (hash, site) rows that are on min_sites sites or more, with sites: exact near the threshold, else estimated."""
    spread = lines.groupBy("hash").agg(F.count("site").alias("n"), F.min("site").alias("low"), F.max("site").alias("high"))
    wide = (F.col("n") >= min_sites) & ((F.col("low") != F.col("high")) | F.lit(min_sites <= 1))
    candidates = scratch(spread.filter(wide).select("hash"), "line-candidates")
    found = lines.join(candidates, "hash", "left_semi").select("hash", "site")
    sketched = found.groupBy("hash").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    sketched = scratch(sketched.select("hash", F.hll_sketch_estimate("sketch").alias("sites")), "line-sketches")
    margin = NEAR * 1.04 / 2 ** (LG_K / 2) * min_sites + 1
    clear = sketched.filter(F.col("sites") > min_sites + margin)
    near = sketched.filter((F.col("sites") >= min_sites - margin) & (F.col("sites") <= min_sites + margin)).select("hash")
    exact = found.join(near, "hash", "left_semi").groupBy("hash").agg(F.count_distinct("site").alias("sites"))
    return clear.unionByName(exact.filter(F.col("sites") >= min_sites))


def drop_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with n_lines, n_removed and kept_text."""
    key, mark, pos, hash_, site_, gone, n_lines, n_removed, kept = fresh(docs, "_id", "_mark", "_pos", "_hash", "_site", "_gone", "n_lines", "n_removed", "kept_text")
    body = F.coalesce(docs["text"], F.lit(""))
    marked = docs.withColumn(mark, F.xxhash64(body))
    lines = marked.select(F.col("doc_id").alias(key), mark, F.col(site).alias(site_), F.posexplode(F.split(body, "\n", -1)).alias(pos, "line"))
    lines = lines.filter(F.btrim("line") != "").select(key, mark, site_, pos, line_hash(F.col("line")).alias(hash_))
    lines = scratch(lines, "lines")
    bad = scratch(boilerplate(lines.select(F.col(hash_).alias("hash"), F.col(site_).alias("site")), min_sites), "boilerplate")
    hits = lines.join(bad.select(F.col("hash").alias(hash_)), hash_, "left_semi")
    hits = hits.groupBy(key, F.col(mark).alias(f"{mark}r")).agg(F.collect_set(pos).alias(gone))
    out = marked.join(hits.hint("shuffle_hash"), marked["doc_id"].eqNullSafe(hits[key]) & (marked[mark] == hits[f"{mark}r"]), "left")
    all_lines = F.split(body, "\n", -1)
    # Lines are split once, and picked by place: a search through the removed places for each line would be quadratic.
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone)
    left = F.get(F.transform(F.array(all_lines), lambda parts: F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")), F.lit(0))
    out = out.withColumns(
        {
            n_lines: F.size(all_lines).cast("long"),
            n_removed: F.coalesce(F.size(gone), F.lit(0)).cast("long"),
            kept: F.when(F.col(gone).isNull(), body).otherwise(left),
        }
    )
    return out.select(*[out[c] for c in docs.columns], n_lines, n_removed, kept)


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with their boilerplate lines gone; docs' columns."""
    out = drop_lines(docs, site, min_sites)
    kept = out.columns[-1]
    return out.select(*[F.col(kept).alias(c) if c == "text" else F.col(c) for c in docs.columns])


def report(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    out = drop_lines(docs.select("doc_id", "text", site), site, min_sites)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
