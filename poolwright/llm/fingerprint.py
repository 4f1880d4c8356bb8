"""Document fingerprints by randomised edit embedding, with bit-sampled banding and verification.

A pointer walks over the characters of a text: at step j it emits the character it stands on and moves on if a random table shared by all texts says so
for (j, character). Texts a few edits apart soon walk in step again, so edit distance becomes Hamming distance between
emitted sequences. The embedding of n characters has 3n steps. A fingerprint keeps one random bit of the emitted character at sampled steps: all of the
first 128, then 128 in each octave [2^k, 2^(k+1)), so short and long texts share their early samples. likeness() weighs each
octave by the steps it stands for and turns agreement of bits into a share of equal characters.

For near-duplicate search equal fingerprints are one class, bands of sampled bits bucket the classes, each meets the least of its buckets, and pairs are verified on whole
fingerprints. Where a bucket still holds several components, every class outside its largest one is held against the others, in blocks of bounded size. After this, any two
like texts that share a bucket are in one component. At likeness 0.95, 0.9 and 0.85 two texts share a band with probability 1, 0.98 and 0.87.

Neighbours in id order come from buckets of id ranges: each bucket also gets the first row of the next one, so texts are shuffled once. What banding found of a
text travels to its bucket as a row of its own.

Defined cases: null is the empty text; the fingerprint of an empty text has no bits, and is like another empty one (1) and unlike any other (0); rows that share a
doc_id follow each other in order of text and have their links in common; a null doc_id comes last and links with nothing; a single row is its own successor; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import scratch
from poolwright.llm.components import components, join_components, meet_in_blocks
from poolwright.session import ship

PER_OCTAVE = 128
#: Octaves of steps beyond the first 128; a text that walks on has its later steps unsampled.
OCTAVES = 30
#: Rows of the shared table of moves, reused in turn.
MOVES = 4096
#: Bands, bits of each, and the likeness that verifies a pair.
BANDS, BAND_BITS, LIKE = 12, 24, 0.85
LAST = (1 << 63) - 1
#: Classes of a bucket that are held against those of another block, at most or so.
CLASSES = 2_000
#: Pairs of a block that are compared at once, or the pairs of one class.
PAIRS = 512
#: So few texts walk on one by one, which costs less than steps of whole arrays.
FEW = 24

_rng = np.random.default_rng(97)
_moves = _rng.integers(0, 2, (MOVES, 256), dtype=np.uint8)
_moves[:, 0] = 0  # the symbol after a text's end holds the pointer
_steps = [np.arange(PER_OCTAVE)]
for _k in range(7, 7 + OCTAVES):
    _steps.append(np.arange(1 << _k, 2 << _k) if _k == 7 else np.unique(_rng.integers(1 << _k, 2 << _k, 2 * PER_OCTAVE))[:: 2][:PER_OCTAVE])
SAMPLED = np.concatenate(_steps)
OCTAVE_OF = np.repeat(np.arange(len(_steps)), [len(x) for x in _steps])
OCTAVE_START = np.array([0, *[1 << k for k in range(7, 7 + OCTAVES)]])
OCTAVE_END = np.array([1 << k for k in range(7, 8 + OCTAVES)])
_bits = _rng.integers(0, 2, (len(SAMPLED), 256), dtype=np.uint8)


def symbols(text: str) -> np.ndarray:
    """Each character as one of 1..255."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (1 + ((points * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(255)).astype(np.uint8)


def samples_of(n: int) -> int:
    """Number of bits that a text of n characters has: those of the octaves that its 3n steps reach."""
    if not n:
        return 0
    octave = int(np.searchsorted(OCTAVE_END, 3 * n - 1, side="right"))
    return int(np.searchsorted(OCTAVE_OF, octave, side="right"))


_MOVES = _moves.tobytes()


def _walk_on(buffer: np.ndarray, at: int, step: int, sampled: list[int], k: int, seen: np.ndarray) -> None:
    """Walk one text from a position and step on, noting its characters at the sampled steps from the k-th on. Ends with the text: what follows is the end symbol, 0."""
    end = at + int(np.flatnonzero(buffer[at:] == 0)[0]) if buffer[at] else at
    text, moves, mask, at = buffer[at : end + 1].tobytes(), _MOVES, MOVES - 1, 0
    for stop in sampled[k:-1]:
        for j in range(step, stop):
            at += moves[(j & mask) << 8 | text[at]]
        step = stop
        if not text[at]:
            return
        seen[k] = text[at]
        k += 1


def embed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sampled bits (a row for each text, zero-padded by the bits of the end symbol) and lengths. All texts walk in lockstep."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    buffer = np.zeros(int(lengths.sum()) + len(texts), np.uint8)
    starts = np.zeros(len(texts), np.int64)
    at = 0
    for i in order:
        starts[i] = at
        if lengths[i]:
            buffer[at : at + lengths[i]] = symbols(texts[i])
        at += lengths[i] + 1
    width = samples_of(int(lengths.max(initial=0)))
    seen = np.zeros((width, len(texts)), np.uint8)
    who, pos = order, starts[order]
    sampled, next_sample = SAMPLED[:width].tolist() + [-1], 0
    for j in range(3 * int(lengths.max(initial=0))):
        if not j & 255:
            walking = (buffer[pos] != 0) & (3 * lengths[who] > j)
            if not walking.all():
                who, pos = who[walking], pos[walking]
            if len(who) <= FEW:
                for i, at in zip(who.tolist(), pos.tolist()):
                    _walk_on(buffer, at, j, sampled, next_sample, seen[:, i])
                break
        c = buffer.take(pos)
        if j == sampled[next_sample]:
            seen[next_sample, who] = c
            next_sample += 1
        pos += _moves[j & (MOVES - 1)].take(c)
    # Steps past 3n do not belong to a text.
    seen[SAMPLED[:width, None] >= 3 * lengths[None, :]] = 0
    return np.take_along_axis(_bits[:width], seen, axis=1).T, lengths


def likeness(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Likeness of row i of a and of b, 0 to 1. Only steps that the longer text's walk takes on average, 2n, count."""
    if not len(na):
        return np.zeros(0)
    width = a.shape[1]
    reach = 2 * np.maximum(na, nb)
    inside = SAMPLED[None, :width] < reach[:, None]
    octaves = OCTAVE_OF[:width]
    first = np.flatnonzero(np.r_[True, octaves[1:] != octaves[:-1]]) if width else np.empty(0, int)
    if not width:
        return np.ones(len(na))
    counted = np.add.reduceat(inside, first, axis=1, dtype=np.int64)
    equal = np.add.reduceat((a == b) & inside, first, axis=1, dtype=np.int64)
    k = len(first)
    weight = np.clip(np.minimum(OCTAVE_END[None, :k], reach[:, None]) - OCTAVE_START[None, :k], 0, None) * (counted > 0)
    share = 2.0 * equal / np.maximum(counted, 1) - 1
    out = np.clip((weight * share).sum(axis=1) / np.maximum(weight.sum(axis=1), 1), 0, 1)
    return np.where(na + nb == 0, 1.0, np.where((na == 0) | (nb == 0), 0.0, out))


def render(bits: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Fingerprints as text: length in hex, a colon, the bits in hex."""
    return [f"{n:x}:" + np.packbits(row[: samples_of(int(n))]).tobytes().hex() for row, n in zip(bits, lengths)]


def parse(fingerprint: str) -> tuple[int, np.ndarray]:
    length, _, digits = fingerprint.partition(":")
    n = int(length, 16)
    return n, np.unpackbits(np.frombuffer(bytes.fromhex(digits), np.uint8))[: samples_of(n)]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_links long, like_id long, class_id long"

#: What banding finds of a text.
FOUND = ["n_links", "like_id", "class_id"]


def _with_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, kind, doc_id, text, n_links, like_id, class_id) in order. Kind 0: a text; 1: its links, before it; 2: the first text of the next bucket. Every text is followed by its successor."""
    carry: list[tuple] = []
    links: tuple = (None, 0, None, None)
    for batch in batches:
        columns = batch.to_pydict()
        rows = carry
        for kind, doc_id, text, *found in zip(*(columns[c] for c in ("kind", "doc_id", "text", *FOUND))):
            if kind == 1:
                links = (doc_id, *found)
            else:
                known = links if doc_id is not None and links[0] == doc_id else (doc_id, 0, doc_id, doc_id)
                rows.append((kind == 2, doc_id, text, *known[1:]))
        carry = rows[-1:]
        own = [i for i in range(len(rows) - 1) if not rows[i][0]]
        if not own:
            continue
        texts = [r[2] for r in rows]
        halves = [len(texts[i]) // 2 for i in own]
        edited = [texts[i][: len(texts[i]) - h] + texts[i + 1][:h] for i, h in zip(own, halves)]
        bits, lengths = embed(texts + edited)
        mine, after, changed = np.array(own), np.array(own) + 1, np.arange(len(texts), len(texts) + len(own))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i in own], pa.int64()),
                pa.array(lengths[mine]),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                pa.array(render(bits[mine], lengths[mine])),
                pa.array(render(bits[changed], lengths[changed])),
                pa.array(likeness(bits[mine], lengths[mine], bits[changed], lengths[changed])),
                pa.array(likeness(bits[mine], lengths[mine], bits[after], lengths[after])),
                *(pa.array([rows[i][k] for i in own], pa.int64()) for k in (3, 4, 5)),
            ],
            names=[x.split()[0] for x in RESULT.split(", ")],
        )


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (second half from the next document), their likenesses, and what banding links the text with:
    the number of its verified links, the least doc_id among them and itself, and the least doc_id that links reach."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(LAST)))
    shares = [i / (4 * parts) for i in range(1, 4 * parts)]
    cuts = np.unique(np.array(rows.agg(F.percentile_approx("key", shares, 100_000)).first()[0] or [0], np.int64))

    @F.pandas_udf("int")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(), side="right").astype(np.int32))

    # The first key of each bucket; there are as many as cuts.
    firsts = [(r["bucket"], r["first"]) for r in rows.select("key", bucket("key").alias("bucket")).groupBy("bucket").agg(F.min("key").alias("first")).orderBy("bucket").collect()]
    halo = [(firsts[i - 1][0], first) for i, (_, first) in enumerate(firsts)]
    halos = F.broadcast(spark.createDataFrame(halo, "bucket int, key long"))
    no_links = [F.lit(None).cast("long").alias(c) for c in FOUND]
    text = rows.select(bucket("key").alias("bucket"), F.lit(0).alias("kind"), "key", "doc_id", "text", *no_links)
    next_text = rows.join(halos, "key").select("bucket", F.lit(2).alias("kind"), "key", "doc_id", "text", *no_links)
    linked = near_classes(docs)
    linked = linked.select(bucket("doc_id").alias("bucket"), F.lit(1).alias("kind"), F.col("doc_id").alias("key"), "doc_id", F.lit(None).cast("string").alias("text"), *FOUND)
    # A bucket's own rows by key, links before the texts they are of; then the next bucket's first.
    order = ["bucket", F.col("kind") == 2, "key", F.col("kind") == 0, "text"]
    placed = text.unionByName(next_text).unionByName(linked).repartition(parts, "bucket").sortWithinPartitions(*order)
    return placed.select("bucket", "kind", "doc_id", "text", *FOUND).mapInArrow(_with_edits, RESULT)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits, lengths = embed(batch.column(1).to_pylist())
        packed = [np.packbits(row[: samples_of(int(n))]).tobytes() for row, n in zip(bits, lengths)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), pa.array(packed, pa.binary())], names=["doc_id", "n", "bits"])


def _picks() -> list[np.ndarray]:
    """The samples that each band of each length class takes: of those steps that every text of the class walks."""
    return [np.random.default_rng(level).integers(0, max(1, int(np.searchsorted(SAMPLED, 1 << (level + 1)))), (BANDS, BAND_BITS)) for level in range(OCTAVES)]


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, doc_id): length class, number and bits of each band in one number. A text near the lower end of its length class also joins the class below."""
    picks, weights = _picks(), 1 << np.arange(BAND_BITS, dtype=np.int64)
    for batch in batches:
        bands, counts = [], []
        for n, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            row = np.unpackbits(np.frombuffer(packed, np.uint8))
            levels = sorted({int(np.log2(max(int(n * f), 1))) for f in (1, LIKE)})
            for level in levels:
                bands.append(((level * BANDS + np.arange(BANDS)) << BAND_BITS) + row[picks[level]] @ weights)
            counts.append(BANDS * len(levels))
        flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
        owners = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), counts)))
        yield pa.RecordBatch.from_arrays([pa.array(flat.astype(np.int64)), owners], names=["band", "doc_id"])


def _padded(lengths: list[int], packed: list[bytes]) -> np.ndarray:
    """Bits of fingerprints, a row for each, as embed() gives them: behind a text's own the bits of the end symbol."""
    rows = [np.unpackbits(np.frombuffer(p, np.uint8))[: samples_of(n)] for n, p in zip(lengths, packed)]
    out = np.tile(_bits[: max(map(len, rows), default=0), 0], (len(rows), 1))
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likeness of pairs (a, na, fa, b, nb, fb)."""
    for batch in batches:
        a, na, fa, b, nb, fb = batch.columns
        out = []
        for n, p, m, q in zip(na.to_pylist(), fa.to_pylist(), nb.to_pylist(), fb.to_pylist()):
            bits = _padded([n, m], [p, q])
            out.append(float(likeness(bits[:1], np.array([n]), bits[1:], np.array([m]))[0]))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(out, pa.float64())], names=["a", "b", "likeness"])


def _stars(banded: DataFrame, prints: DataFrame, like: float) -> DataFrame:
    """Verified pairs of each class and the least class of every bucket they share."""
    centres = banded.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a <> z").select("band", "a")
    pairs = banded.join(scratch(centres, "edit-centres"), "band").filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    pairs = scratch(pairs, "edit-pairs")
    both = pairs.join(prints.toDF("a", "na", "fa"), "a").join(prints.toDF("b", "nb", "fb"), "b").select("a", "na", "fa", "b", "nb", "fb")
    # An id on several rows counts by its likest.
    links = both.mapInArrow(_verified, "a long, b long, likeness double").groupBy("a", "b").agg(F.max("likeness").alias("likeness"))
    return scratch(links.filter(F.col("likeness") >= like), "edit-stars")


def _spanning(stars: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what the stars connect: each class with its least centre, and this one with its other centres, of which a class has two a band at most."""
    centres = stars.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("c"))
    edge = lambda to: F.struct(F.col("c")[0].alias("a"), to.alias("b"))
    others = F.transform(F.filter("c", lambda x: x != F.col("c")[0]), edge)
    return centres.select(F.explode(F.concat(F.array(edge(F.col("b"))), others)).alias("e")).select("e.a", "e.b").distinct()


def _off_centre(banded: DataFrame, prints: DataFrame, labels: DataFrame, like: float) -> DataFrame:
    """Verified pairs of classes of different components that share a bucket, one at least for each two components that have any there.

    In each bucket of several components, the classes outside its largest one meet all others, in blocks.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    labelled = scratch(labels.join(sizes, "label").withColumnRenamed("node", "doc_id"), "edit-labels")
    placed = banded.join(labelled, "doc_id", "left")
    placed = scratch(placed.select("band", "doc_id", F.coalesce("label", "doc_id").alias("label"), F.coalesce("members", F.lit(1)).alias("members")), "edit-placed")
    mixed = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("members", "label")).alias("largest"))
    mixed = scratch(mixed.filter("low <> high").select("band", F.col("largest.label").alias("family")), "edit-mixed")
    apart = placed.join(mixed, "band").select("band", "doc_id", "label", (F.col("label") != F.col("family")).alias("outside"))
    rows = meet_in_blocks(scratch(apart, "edit-apart"), ["band"], F.lit(1), CLASSES)

    def compare(block: pa.Table) -> pa.Table:
        ids, labels, n = (block.column(c).to_numpy() for c in ("doc_id", "label", "n"))
        left, bits = block.column("left").to_numpy(), _padded(n.tolist(), block.column("bits").to_pylist())
        mine, others, found = np.flatnonzero(left), np.flatnonzero(~left), {}
        rows = max(1, PAIRS // max(1, len(others)))
        for low in range(0, len(mine), rows):
            i, j = (x.ravel() for x in np.meshgrid(mine[low : low + rows], others, indexing="ij"))
            i, j = i[labels[i] != labels[j]], j[labels[i] != labels[j]]
            likes = likeness(bits[i], n[i], bits[j], n[j])
            for x, y, value in zip(i[likes >= like].tolist(), j[likes >= like].tolist(), likes[likes >= like].tolist()):
                found.setdefault((min(labels[x], labels[y]), max(labels[x], labels[y])), (min(ids[x], ids[y]), max(ids[x], ids[y]), value))
        a, b, value = zip(*found.values()) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "likeness": pa.array(value, pa.float64())})

    # Small rows, much work: as many tasks as partitions are asked for, however few bytes there are.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.join(prints, "doc_id").repartition(parts, "band", "i", "j")
    links = placed.groupBy("band", "i", "j").applyInArrow(compare, "a long, b long, likeness double")
    return scratch(links.groupBy("a", "b").agg(F.max("likeness").alias("likeness")), "edit-off-centre")


def _near(docs: DataFrame, like: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b, likeness) of classes, known by their least doc_id; labels (node, label) of the classes that have any; and each document's classes (a, doc_id)."""
    ship(docs.sparkSession)
    rows = docs.filter("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = scratch(rows.mapInArrow(_prints, "doc_id long, n long, bits binary"), "edit-prints")
    classes = scratch(prints.groupBy("n", "bits").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "n", "bits"), "edit-classes")
    member_of = scratch(prints.join(classes.withColumnRenamed("doc_id", "a"), ["n", "bits"]).select("a", "doc_id").distinct(), "edit-members")
    # An id on several rows joins the classes of its texts.
    several = member_of.groupBy("doc_id").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("doc_id")
    bridges = scratch(member_of.join(several, "doc_id", "left_semi").select("a", F.col("doc_id").alias("b")), "edit-bridges")
    banded = scratch(classes.mapInArrow(_bands, "band long, doc_id long"), "edit-bands")
    links = _stars(banded, classes, like)
    labels = components(_spanning(links).unionByName(bridges))
    more = _off_centre(banded, classes, labels, like)
    return links.unionByName(more).distinct(), join_components(labels, more), member_of


def _with_copies(links: DataFrame, member_of: DataFrame) -> DataFrame:
    copies = member_of.filter("a <> doc_id").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("likeness"))
    return links.unionByName(copies).groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def near_links(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """Verified pairs (a, b, likeness), a < b, that connect all like texts which share a bucket. Of equal texts each is linked with the least doc_id, which stands for them in all other links."""
    links, _, member_of = _near(docs, like)
    return _with_copies(links, member_of)


def near_classes(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """(doc_id, n_links, like_id, class_id) of every id that has a link: how many of near_links(), the least id of these and itself, the least id that links reach."""
    links, labels, member_of = _near(docs, like)
    none = F.lit(None).cast("long")
    end = lambda c: F.struct(F.col(c).alias("doc_id"), F.col("a").alias("like_id"), F.lit(1).cast("long").alias("n_links"), none.alias("class_id"))
    ends = _with_copies(links, member_of).select(F.explode(F.array(end("a"), end("b"))).alias("e")).select("e.*")
    label = F.coalesce("label", "a")
    reached = member_of.join(labels.withColumnRenamed("node", "a"), "a", "left").filter(label != F.col("doc_id"))
    reached = reached.select("doc_id", none.alias("like_id"), F.lit(0).cast("long").alias("n_links"), label.alias("class_id"))
    found = ends.unionByName(reached).groupBy("doc_id").agg(F.sum("n_links").alias("n_links"), F.min("like_id").alias("like_id"), F.min("class_id").alias("class_id"))
    return found.select("doc_id", "n_links", F.coalesce("like_id", "doc_id").alias("like_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
