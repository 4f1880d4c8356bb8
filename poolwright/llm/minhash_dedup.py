"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

1. One pass over the texts gives each document's set of five-word shingles, its digest, 256 minima (four one-permutation sketches of 64
   bins, empty bins filled from bins that a fixed random probe order names), 256 single bits of them and 51 band keys of five minima.
2. Equal sets collapse to classes. In each bucket of a band every class meets two centres only, the one that meets most classes in all bands and the
   least (a star), if sizes and single bits allow the threshold. Pairs are confirmed on the full sets, and confirmed pairs give components.
3. Stars can miss a link between classes of one bucket that are both far from its centres. So where a bucket still holds several components,
   every class outside its largest component is held against the other components' classes, in blocks of bounded size: first sizes and single bits
   alone, then the full sets of the few classes that these leave. Blocks give out links only. After this, any two linked classes that share a bucket are in one component.

At similarity 0.75 two sets share no bucket with probability (1 - 0.75 ** 5) ** 51, about 1e-6 (somewhat more for sets of few shingles).

Defined cases: null, empty and blank texts have empty sets and link with nothing; texts of fewer words than a shingle are one shingle; rows that share a doc_id
are one document; a row with a null doc_id links with nothing, has a null component_id and stays; of equal sets the smallest doc_id represents the others;
an empty table gives an empty result; further columns pass through the stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import keep_matching, scratch
from poolwright.llm.components import components, meet_in_blocks
from poolwright.llm.shingles import mix, shingle_set, similar
from poolwright.session import ship

WORDS, PERCENT = 5, 75
SKETCHES, BINS = 4, 64
ROWS, BANDS = 5, 51
#: Single bits that may differ: 32 are expected at similarity 0.75, 5.3 is their deviation; small sets deviate more.
MOST_BITS = 84
#: Classes in a block whose single bits are held against those of another, and shingles in a block whose sets are, at most or so.
CLASSES, SHINGLES = 2_000, 200_000
#: Members of a centre that are confirmed in one place; a centre's text is sent once to each such place.
MEMBERS = 500
SIGNATURE = "doc_id long, n long, d0 long, d1 long, b0 long, b1 long, b2 long, b3 long, bands array<long>"

_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 6)
#: Where bin e of each sketch looks for a minimum, in order.
_PROBES = np.stack([np.random.default_rng(k).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1) for k in range(SKETCHES)])
_BIT_SEEDS = mix(np.arange(1000, 1000 + SKETCHES * BINS, dtype=np.uint64))
_BAND_SEEDS = mix(np.arange(5000, 5000 + BANDS, dtype=np.uint64))
_BAND_ODD = mix(np.arange(9000, 9000 + ROWS, dtype=np.uint64)) | np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The densified sketches of a set that isn't empty, one after the other."""
    out = np.empty((SKETCHES, BINS), np.uint64)
    for k in range(SKETCHES):
        x = np.sort(mix(shingles ^ _SEEDS[k]))
        at = np.searchsorted(x, _EDGES)
        first = x[np.minimum(at, len(x) - 1)]
        full = (at < len(x)) & (first >> np.uint64(58) == np.arange(BINS, dtype=np.uint64))
        donor = _PROBES[k][np.arange(BINS), full[_PROBES[k]].argmax(axis=1)]
        out[k] = first[np.where(full, np.arange(BINS), donor)]
    return out.ravel()


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four words of single bits, and the band keys."""
    v = minima(shingles)
    bits = np.packbits((mix(v ^ _BIT_SEEDS) >> np.uint64(63)).astype(np.uint8)).view(np.int64)
    rows = v[: BANDS * ROWS].reshape(BANDS, ROWS)
    return bits, mix((rows * _BAND_ODD).sum(axis=1) ^ _BAND_SEEDS).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        m = len(batch)
        n, digests, bits = np.zeros(m, np.int64), np.zeros((m, 2), np.int64), np.zeros((m, 4), np.int64)
        ends, bands = np.zeros(m + 1, np.int32), []
        for i in range(m):
            u = shingle_set(texts[i].as_py(), WORDS)
            n[i] = len(u)
            if len(u):
                digests[i] = np.array([mix(u ^ s).sum() for s in _SEEDS[:2]], np.uint64).view(np.int64)
                bits[i], keys = signature(u)
                bands.append(keys)
            ends[i + 1] = len(bands) * BANDS
        flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
        columns = [ids, pa.array(n), *map(pa.array, digests.T), *map(pa.array, bits.T), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d0", "d1", "b0", "b1", "b2", "b3", "bands"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (centre, member, text) in order: a centre's own row, without a member, comes before its members'."""
    of = np.empty(0, np.uint64)
    for batch in batches:
        centres, members, texts = batch.columns
        a, b = [], []
        for centre, member, text in zip(centres.to_pylist(), members.to_pylist(), texts):
            if member is None:
                of = shingle_set(text.as_py(), WORDS)
            elif similar(shingle_set(text.as_py(), WORDS), of, PERCENT):
                a.append(min(centre, member))
                b.append(max(centre, member))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near(x: str, y: str) -> Column:
    """Whether sizes and single bits of two classes allow the threshold; x, y: prefixes of their columns."""
    a, b = F.col(f"{x}n"), F.col(f"{y}n")
    bits = sum((F.bit_count(F.col(f"{x}b{k}").bitwiseXOR(F.col(f"{y}b{k}"))) for k in range(4)), F.lit(0))
    return (a * 100 >= b * PERCENT) & (b * 100 >= a * PERCENT) & (bits <= MOST_BITS)


def confirm(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among stars (doc_id, centre): full sets reach the threshold. texts: doc_id, text of all that occur.

    Members come to their centre, in places of MEMBERS or so; each place gets the centre's text once, in front, so no text is copied pair by pair.
    """
    stars = scratch(stars.distinct(), "near-pairs")
    load = stars.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("places"))
    load = scratch(load, "near-places")
    member = stars.join(load, "centre").select("centre", F.pmod(F.hash("doc_id"), F.col("places")).alias("place"), F.col("doc_id").alias("member"), "doc_id").join(texts, "doc_id")
    centre = load.select("centre", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(None).cast("long").alias("member"), F.col("centre").alias("doc_id")).join(texts, "doc_id")
    rows = centre.unionByName(member).repartition("centre", "place").sortWithinPartitions("centre", "place", F.col("member").asc_nulls_first())
    return scratch(rows.select("centre", "member", "text").mapInArrow(_confirm, "a long, b long"), "near-links")


def _fits(n: np.ndarray, labels: np.ndarray, bits: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Those of others whose label differs from row i's, and whose size and single bits allow a link with it. bits: unsigned, as those of a negative number would be counted of its absolute value."""
    differ = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
    return others[(labels[others] != labels[i]) & (n[others] * 100 >= n[i] * PERCENT) & (n[i] * 100 >= n[others] * PERCENT) & (differ <= MOST_BITS)]


HOPEFUL = ["band", "i", "j", "left", "doc_id", "label", "n", "b0", "b1", "b2", "b3"]


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that may have a link, of blocks that come in order. A block that goes on in the next batch is held over."""
    held = None

    def found(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), bool)
        key = rows[:, :3]
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        for low, high in zip(starts, np.r_[starts[1:], len(rows)]):
            own = rows[low:high]
            labels, n, bits = own[:, 5], own[:, 6], np.ascontiguousarray(own[:, 7:]).view(np.uint64)
            right = np.flatnonzero(own[:, 3] == 0)
            for i in np.flatnonzero(own[:, 3]):
                fits = _fits(n, labels, bits, i, right)
                out[low + fits] = True
                out[low + i] |= bool(len(fits))
        return np.unique(rows[out, 4])

    for batch in batches:
        rows = np.stack([c.cast(pa.int64()).to_numpy() for c in batch.columns], axis=1)
        rows = rows if held is None else np.concatenate([held, rows])
        last = int(np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])[-1]) if len(rows) else 0
        held = rows[last:]
        yield pa.RecordBatch.from_arrays([pa.array(found(rows[:last]) if last else np.empty(0, np.int64))], names=["doc_id"])
    if held is not None and len(held):
        yield pa.RecordBatch.from_arrays([pa.array(found(held))], names=["doc_id"])


def _missed(crowd: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between classes of different components that share a bucket.

    In each bucket that holds several components, the classes outside its largest one meet all others: sizes and single bits say which of them may have
    a link at all. Only these classes' texts are fetched. They meet by family (the buckets of one largest component), so that no pair is confirmed in every bucket.
    """
    figures = ["n", "b0", "b1", "b2", "b3"]
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    labelled = scratch(labels.join(sizes, "label").withColumnRenamed("node", "own"), "near-labels")
    placed = crowd.join(labelled, crowd["doc_id"] == labelled["own"], "left")
    placed = scratch(placed.select("band", "doc_id", *figures, F.coalesce("label", "doc_id").alias("label"), F.coalesce("members", F.lit(1)).alias("members")), "placed")
    mixed = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("members", "label")).alias("largest"))
    mixed = scratch(mixed.filter("low <> high").select("band", F.col("largest.label").alias("family")), "mixed")
    apart = placed.join(mixed, "band").select("band", "family", "doc_id", "label", *figures, (F.col("label") != F.col("family")).alias("outside"))
    apart = scratch(apart, "apart")

    met = meet_in_blocks(apart.drop("family"), ["band"], F.lit(1), CLASSES).select(*HOPEFUL)
    met = met.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    hopeful = scratch(met.mapInArrow(_hopeful, "doc_id long").distinct(), "hopeful")

    family = scratch(apart.join(hopeful, "doc_id", "left_semi").drop("band").distinct(), "families")
    rows = scratch(meet_in_blocks(family, ["family"], F.col("n"), SHINGLES), "blocks").join(texts, "doc_id")
    return scratch(rows.groupBy("family", "i", "j").applyInArrow(_compare, "a long, b long").distinct(), "missed-links")


def _compare(block: pa.Table) -> pa.Table:
    """Links between the left rows of a block and its other rows of different label, one at least for each two labels that have any."""
    ids, labels, n = (block.column(c).to_numpy() for c in ("doc_id", "label", "n"))
    left = block.column("left").to_numpy()
    bits = np.stack([block.column(f"b{k}").to_numpy() for k in range(4)], axis=1).view(np.uint64)
    sets: dict[int, np.ndarray] = {}

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(block.column("text")[i].as_py(), WORDS)
        return sets[i]

    right, found = np.flatnonzero(~left), {}
    for i in np.flatnonzero(left):
        for j in _fits(n, labels, bits, i, right):
            two = (min(labels[i], labels[j]), max(labels[i], labels[j]))
            if two not in found and similar(shingles(int(i)), shingles(int(j)), PERCENT):
                found[two] = (min(ids[i], ids[j]), max(ids[i], ids[j]))
    a, b = zip(*found.values()) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch(source.mapInArrow(_signatures, SIGNATURE), "signatures")
    linked = signed.filter("n > 0 and doc_id is not null")
    classes = scratch(linked.groupBy("d0", "d1").agg(F.min("doc_id").alias("doc_id")), "classes")
    figures = ["n", "b0", "b1", "b2", "b3"]
    one_each = linked.join(classes, ["d0", "d1", "doc_id"], "left_semi").select("doc_id", *figures, "bands").dropDuplicates(["doc_id"])
    one_each = scratch(one_each, "class-bands")
    banded = one_each.select(F.explode("bands").alias("band"), "doc_id", *figures)

    # Buckets of several classes. A class that meets many others is central; each bucket's most central class and its least are its centres.
    several = scratch(banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    crowd = scratch(banded.join(several, "band"), "crowd")
    central = scratch(crowd.groupBy("doc_id").agg(F.sum("size").alias("met")), "central")
    most = F.max(F.struct("met", (-F.col("doc_id")).alias("minus"), *figures)).alias("m")
    least = F.min(F.struct("doc_id", *figures)).alias("l")
    centres = crowd.join(central, "doc_id").groupBy("band").agg(most, least)
    named = [(-F.col("m.minus")).alias("m_doc_id"), F.col("l.doc_id").alias("l_doc_id"), *[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in "ml" for x in figures]]
    met = crowd.join(scratch(centres.select("band", *named), "centres"), "band")
    to = F.array(*[F.when((F.col("doc_id") != F.col(f"{c}doc_id")) & near("", c), F.col(f"{c}doc_id")) for c in ("m_", "l_")])
    stars = met.filter(F.exists(to, lambda x: x.isNotNull())).select("doc_id", F.explode(F.array_compact(to)).alias("centre"))

    # Texts of the classes that share a bucket with any other, fetched once.
    texts = scratch(keep_matching(source, central), "near-texts")
    links = confirm(stars, texts)
    labels = components(links)
    labels = components(links.unionByName(_missed(crowd, labels, texts)))

    # Component of a class, then of its documents.
    of_class = classes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    of_class = scratch(of_class.select("d0", "d1", F.coalesce("label", "doc_id").alias("component_id")), "class-components")
    rows = signed.select("doc_id", "n", "d0", "d1").withColumn("alone", F.expr("n = 0 or doc_id is null"))
    joined = rows.filter("not alone").join(of_class, ["d0", "d1"]).select("doc_id", "n", "component_id")
    alone = rows.filter("alone").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = joined.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each component; docs' columns."""
    kept = near_components(docs).filter("kept").select("doc_id").distinct()
    return keep_matching(docs, kept)
