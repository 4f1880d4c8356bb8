"""Secret scans over an incremental blob ledger, with DataFrame functions alone.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds, per blob, which rule versions have scanned it and the
spans they found. A scan takes the (blob, rule version) pairs that the ledger lacks, reads one text per such blob, appends what it
finds, and joins the ledger's spans back to all paths that hold the blob.

Rules: the three base kinds (assign, access, hex), and two that the operator adds (pem: a private key's first line; jwt: a signed web token).

Defined cases: a null text is the empty text; rows that share a doc_id are versions of one path and each gets its own result; a null doc_id is a path; equal
texts are scanned once; very long texts are scanned whole, in one task each; a pair that the ledger has twice counts once; an empty table gives an empty result;
offsets count code points, ends are exclusive; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.utils import AnalysisException

from poolwright.llm.common import scratch, scratch_path


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of pattern count if group has at least least code points; a match that fails is consumed all the same."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    base: bool = True

    @property
    def label(self) -> str:
        return f"{self.kind}@{self.version}"


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
RULES = (
    Rule("assign", 1, rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"(AKIA[A-Z0-9]+)", 1, 20),
    Rule("hex", 1, r"([0-9a-f]{24,})", 1, 24),
    Rule("pem", 1, r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)", 1, 27, base=False),
    Rule("jwt", 1, r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})", 1, 40, base=False),
)
LEDGER = "blob binary, rules array<string>, spans array<struct<start:long,rank:int,kind:string,stop:long,base:boolean>>"


class Ledger:
    """Append-only Parquet table of scanned blobs: blob, the rule versions of one scan, the spans they found."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], LEDGER)


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (rank, piece, hit, ok): lengths of the text before each match and of the match, in order."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    each = F.transform(
        hits,
        lambda hit, i: F.struct(
            F.lit(rank).alias("rank"), i.alias("i"), F.length(F.get(pieces, i)).alias("piece"), F.length(hit).alias("hit"), (F.length(F.get(parts, i)) >= rule.least).alias("ok")
        ),
    )
    return F.when(text.rlike(rule.pattern), each)


def find(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Spans of each (blob, text, todo): one ledger row per blob. todo: the labels of the rules to run."""
    found = [F.when(F.array_contains("todo", r.label), matches(F.col("text"), r, k)) for k, r in enumerate(rules)]
    none = F.array().cast("array<struct<rank:int,i:int,piece:int,hit:int,ok:boolean>>")
    hits = texts.select("blob", F.flatten(F.array(*[F.coalesce(x, none) for x in found])).alias("hits"))
    hits = hits.filter(F.size("hits") > 0).select("blob", F.inline("hits"))
    upto = W.partitionBy("blob", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    stop = F.sum(F.col("piece") + F.col("hit")).over(upto)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    bases = F.array(*[F.lit(r.base) for r in rules])
    spans = hits.select("blob", "rank", "ok", stop.alias("stop"), (stop - F.col("hit")).alias("start")).filter("ok")
    span = F.struct(F.col("start"), F.col("rank"), F.element_at(kinds, F.col("rank") + 1).alias("kind"), F.col("stop"), F.element_at(bases, F.col("rank") + 1).alias("base"))
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks, append it, and return per row of docs: doc_id, blob, spans of the current rules (empty if none)."""
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, scratch_path(spark, "ledger"))
    addressed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), blob(F.col("text")).alias("blob"))
    paths = scratch(addressed.select("doc_id", "blob"), "paths")
    labels = [r.label for r in rules]
    # One path stands for each blob; each blob meets each rule version, of which there are as many as rules.
    pairs = paths.groupBy("blob").agg(F.min("doc_id").alias("path")).select("blob", "path", F.explode(F.array(*map(F.lit, labels))).alias("rule"))
    seen = ledger.table().select("blob", F.explode("rules").alias("rule"))
    todo = pairs.join(seen, ["blob", "rule"], "left_anti").groupBy("blob", "path").agg(F.array_sort(F.collect_list("rule")).alias("todo"))
    todo = scratch(todo.withColumnRenamed("blob", "todo_blob"), "todo")
    texts = addressed.join(todo.hint("shuffle_hash"), addressed["doc_id"].eqNullSafe(todo["path"]) & (F.col("blob") == F.col("todo_blob")))
    spans = find(texts.select("blob", "text", "todo").dropDuplicates(["blob"]) if _shared(paths) else texts, rules)
    scanned = todo.select(F.col("todo_blob").alias("blob"), F.col("todo").alias("rules")).join(spans, "blob", "left")
    scanned.write.mode("append").parquet(ledger.path)
    # Of a ledger row, only the spans of rule versions that are current count. Two scans at once may both have appended a pair's spans: they are equal, and count once.
    current = ledger.table().withColumn("rules", F.array_intersect("rules", F.array(*map(F.lit, labels))))
    valid = F.filter("spans", lambda s: F.exists("rules", lambda r: F.substring_index(r, "@", 1) == s["kind"]))
    kinds, bases = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.base) for r in rules])
    rank = lambda s: (F.array_position(kinds, s["kind"]) - 1).cast("int")
    ranked = F.transform(valid, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.get(bases, rank(s)).alias("base")))
    current = current.select("blob", ranked.alias("spans")).filter(F.size("spans") > 0)
    current = current.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    current = scratch(current, "findings")
    none = F.array().cast("array<struct<start:long,rank:int,kind:string,stop:long,base:boolean>>")
    return paths.join(current, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def _shared(paths: DataFrame) -> bool:
    """Whether some (doc_id, blob) is on several rows, so that one blob would be read twice."""
    return bool(paths.groupBy("doc_id", "blob").count().filter("count > 1").limit(1).count())


def report(scanned: DataFrame) -> DataFrame:
    """Digest columns of scan()'s rows."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
