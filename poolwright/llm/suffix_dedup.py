"""Removal of long byte strings that occur more than once, within or across documents.

A byte goes if a 400-byte string that covers it starts anywhere else. Every 400-byte window (a suffix cut to 400 bytes) is led by its anchor, the 100-byte
gram in it whose hash is least (the leftmost of equals). Equal windows have equal anchors at equal offsets, so windows meet their like under their anchor.
Consecutive windows of one anchor form a run, of 150 windows on average, and the suffixes that begin at anchors stand in for all others. Suffixes are sorted
(sorted_flags): sampled splitters range-partition them by their leading bytes, each bucket is sorted by multikey quicksort, equal neighbours are compared, and
the ends of the buckets are compared across their boundaries. Behind its leading 8 bytes a suffix is known by 64-bit hashes of what follows. Three such sorts:

1. Runs, by the suffix at the anchor (8 leading bytes, hash of the gram) and the hash of all bytes that the run covers. If equal, all their windows are repeats.
2. A run that equals no other, but whose anchor occurs in other runs, is cut into blocks of 16 windows, as is one run of each other kind under this anchor.
   They are sorted by the suffix that all windows of a block share, then by all bytes they cover. If the former is alone, no window repeats; if the latter is not, all do.
3. Windows of the blocks that are left, by the 400 bytes themselves.

Repeated windows are put together per document and cut out of it (cut_repeats); report() gives sizes and digests of what is left. Row numbers end every sort key, so a string that is in a third of
all documents fills many buckets, and no group is gathered.

Defined cases: a null text is the empty text; a text under 400 bytes keeps all bytes; rows that repeat doc_id and text count as two texts and get equal results; rows that
share a doc_id with other texts are told apart by the text's hash; an empty table gives an empty result; further columns are ignored; texts of many
megabytes are hashed in pieces of 1 MiB that overlap by 399 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwright.llm.common import scratch
from poolwright.session import ship

LENGTH, GRAM = 400, 100
#: Windows of a block, and bytes that are hashed together.
BLOCK, PIECE = 16, 1 << 20
#: Suffixes of a bucket, which one task holds.
BUCKET = 1 << 19
_POSITION = 22  # bits for a position in a piece with its overlap

_table = np.random.default_rng(4711).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1 << 40)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            run = np.full(n + 1, base)
            run[0] = 1
            _powers[k] = np.multiply.accumulate(run)
    return _powers[0], _powers[1]


class Hashed:
    """Hash of any slice of some bytes from two look-ups."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_table[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        return h * _SPREAD


def leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a number; numbers have the order of the bytes."""
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at])
    return (eight.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i that has so many."""
    n = len(x) - width + 1
    pad = -len(x) % width
    rows = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def find_runs(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows: start, number, leading bytes and hash of the anchor, hash of the bytes covered. left: bytes from each position to the end of its text."""
    if len(data) < LENGTH:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashed = Hashed(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = hashed.of(at, at + GRAM)
    ranked = (grams >> np.uint64(_POSITION) << np.uint64(_POSITION)) | at.astype(np.uint64)
    anchor = (sliding_min(ranked, LENGTH - GRAM + 1) & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    anchor[left[: len(anchor)] < LENGTH] = -1
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, len(anchor)])
    real = anchor[first] >= 0
    first, count = first[real], count[real]
    return first, count, leads(data, anchor[first]), grams[anchor[first]], hashed.of(first, first + count + LENGTH - 1)


def _pieces(rows: Iterator[tuple]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts put together (and long ones cut, with overlap) to pieces: keys, bytes, bytes left in the text, owner and offset of each position."""
    keys, parts, size = [], [], 0

    def out():
        data = np.concatenate([p[0] for p in parts])
        left = np.concatenate([np.arange(len(p[0]), 0, -1) for p in parts])
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        offset = np.concatenate([np.arange(p[1], p[1] + len(p[0])) for p in parts])
        return keys, data, left, owner, offset

    for key, text in rows:
        data = np.frombuffer(text, np.uint8)
        for start in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
            cut = data[start : start + PIECE + LENGTH - 1]
            if parts and size + len(cut) > PIECE + LENGTH:
                yield out()
                keys, parts, size = [], [], 0
            keys.append(key)
            parts.append((cut, start))
            size += len(cut)
    if parts:
        yield out()


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


RUNS = "doc_id long, mark long, start int, count int, lead long, anchor long, cover long, part int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for batch in batches:
        rows = (((a.as_py(), b.as_py()), c.as_py()) for a, b, c in zip(*batch.columns))
        for keys, data, left, owner, offset in _pieces(rows):
            first, count, lead, anchor, cover = find_runs(data, left)
            mine = pa.array(owner[first])
            ids, marks = pa.array([k[0] for k in keys], pa.int64()).take(mine), pa.array([k[1] for k in keys], pa.int64()).take(mine)
            own = [ids, marks, _int(offset[first]), _int(count), _long(lead), _long(anchor), _long(cover), _int(np.full(len(first), part))]
            yield pa.RecordBatch.from_arrays(own, names=_names(RUNS))


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several keys: quicksort by the first, then of those that tie by the next, until none tie or no key is left."""
    order = np.argsort(keys[0], kind="quicksort")
    begins = _changes(keys[0][order])
    for key in keys[1:]:
        group = np.cumsum(begins)
        tied = np.flatnonzero(~(begins & np.r_[begins[1:], True]))
        if not len(tied):
            break
        rows = order[tied]
        by_key = np.argsort(key[rows], kind="quicksort")
        rows = rows[by_key[np.argsort(group[tied][by_key], kind="stable")]]
        order[tied] = rows
        new = np.zeros(len(order), bool)
        new[tied] = _changes(key[rows])
        begins = begins | new
    return order


def _changes(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before; the first does."""
    out = np.zeros(len(sorted_keys[0]), bool)
    out[:1] = True
    for key in sorted_keys:
        out[1:] |= key[1:] != key[:-1]
    return out


def _bucket(keys: list[str], ties: list[str], wants: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        columns = [pc.fill_null(rows[name], 0).to_numpy() for name in keys + ties]
        order = multikey_order(columns)
        columns = [c[order] for c in columns[: len(keys)]]
        want = rows[wants].to_numpy()[order] if wants else np.ones(len(order), bool)
        head, begins = _changes(*columns), _changes(*columns[:-1])
        repeat = ~(head & np.r_[head[1:], True])
        edge = np.zeros(len(order), bool)
        edge[[0, -1]] = True
        group = np.cumsum(begins) - 1
        count = lambda what: np.bincount(group, what, group[-1] + 1)
        opened = (count(head) > 1) & (count(want & ~repeat) > 0)
        opened[[0, -1]] = True
        opened = opened[group] & head
        used = np.flatnonzero(repeat | opened | edge)
        out = rows.take(pa.array(order[used]))
        for name, flag in (("repeat", repeat), ("open", opened), ("edge", edge)):
            out = out.append_column(name, pa.array(flag[used]))
        yield from out.to_batches(max_chunksize=1 << 16)

    return sort


def sorted_flags(rows: DataFrame, keys: list[str], ties: list[str], tag: str, wants: str | None = None) -> DataFrame:
    """Rows (a written table) with repeat: whether another row has the same keys, and open: whether the row stands for its keys in a group that is to be looked into.

    A group is all rows that agree in all keys but the last. It is open if its rows differ in the last key, and one that wants (a boolean column; null: all rows)
    is not a repeat; the first and the last group of a bucket, which may go on in the next, are open too. Rows that are neither repeat nor open may be left out.
    Buckets are of about BUCKET rows; ties make the order total, so that equal keys may fill several.
    """
    buckets = -(-rows.count() // BUCKET) or 1
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", repeat boolean, open boolean, edge boolean"
    flags = scratch(rows.repartitionByRange(buckets, *keys, *ties).mapInArrow(_bucket(keys, ties, wants), schema), tag)
    # Across boundaries: keys that two buckets have are at the end of one and the start of another.
    crossing = flags.filter("edge").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)
    lonely = flags.filter("edge and not repeat")
    met = lonely.join(crossing, keys, "left_semi").withColumn("repeat", F.lit(True))
    return flags.filter("not (edge and not repeat)").unionByName(met).unionByName(lonely.join(crossing, keys, "left_anti")).drop("edge")


REGIONS = "doc_id long, mark long, start int, anchor long, alone boolean, count int, bytes binary"


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that each of the given runs (start, count, anchor, alone) covers."""
    for batch in batches:
        out = []
        for doc_id, mark, data, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
            data = memoryview(data.as_buffer())
            out += [(doc_id, mark, r["start"], r["anchor"], r["alone"], r["count"], bytes(data[r["start"] : r["start"] + r["count"] + LENGTH - 1])) for r in runs]
        yield _batch(out, REGIONS)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def anchor_of(hashed: Hashed, count: int) -> int:
    """Where a run's anchor is in its bytes: the least gram among those that all its windows hold, the leftmost of equals."""
    at = np.arange(count - 1, LENGTH - GRAM + 1)
    return int(at[np.argmin(hashed.of(at, at + GRAM) >> np.uint64(_POSITION))])


def blocks_of(data: np.ndarray, count: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Blocks of a run's bytes: first window, windows, leading bytes and hash of the core, hash of the cover.

    A window's distance to the anchor, over BLOCK, is its block, so equal windows are in blocks of equal number. The core is what all BLOCK windows of
    a whole block share; if it occurs once, none of them repeats, and if the cover occurs again, all of them do.
    """
    hashed = Hashed(data)
    anchor = anchor_of(hashed, count)
    number = (anchor - np.arange(count)) // BLOCK
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    size = np.diff(np.r_[first, count])
    low = anchor - BLOCK * number[first]
    core = hashed.of(low, low - (BLOCK - 1) + LENGTH).view(np.int64)
    cover = hashed.of(first, first + size + LENGTH - 1).view(np.int64)
    return zip(first.tolist(), size.tolist(), leads(data, low).tolist(), core.tolist(), cover.tolist())


BLOCKS = "doc_id long, mark long, start int, anchor long, alone boolean, first int, count int, lead long, core long, cover long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, mark, start, anchor, alone, count, data in zip(*(c.to_pylist() for c in batch.columns)):
            for first, size, lead, core, cover in blocks_of(np.frombuffer(data, np.uint8), count):
                out.append((doc_id, mark, start, anchor, alone, start + first, size, lead, core, cover))
        yield _batch(out, BLOCKS)


WINDOWS = "doc_id long, mark long, start int, anchor long, alone boolean, lead long, window long"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leading bytes and hashes of the windows of the given blocks (first, count) of each run."""
    for batch in batches:
        keys, at, sizes, lead, hashes = [], [], [], [], []
        for doc_id, mark, start, anchor, alone, _, data, blocks in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.concatenate([np.arange(b["first"], b["first"] + b["count"]) for b in blocks])
            data = np.frombuffer(data, np.uint8)
            keys.append((doc_id, mark, anchor, alone))
            at.append(own)
            sizes.append(len(own))
            lead.append(leads(data, own - start))
            hashes.append(Hashed(data).of(own - start, own - start + LENGTH))
        if keys:
            which = pa.array(np.repeat(np.arange(len(keys)), sizes))
            own = _batch(keys, "doc_id long, mark long, anchor long, alone boolean").take(which).columns
            columns = [own[0], own[1], _int(np.concatenate(at)), own[2], own[3], _long(np.concatenate(lead)), _long(np.concatenate(hashes))]
            yield pa.RecordBatch.from_arrays(columns, names=_names(WINDOWS))


CUT = "doc_id long, kept binary, spans array<struct<start:long,stop:long>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, sizes, starts, stops = [], [0], [], []
        for data, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            data = data.as_py()
            if spans:
                edge = np.zeros(len(data) + 1, np.int64)
                begins = np.array([s["start"] for s in spans])
                np.add.at(edge, begins, 1)
                np.add.at(edge, begins + np.array([s["count"] for s in spans]) + LENGTH - 1, -1)
                gone = np.cumsum(edge) > 0  # False at the end of the text
                turns = np.flatnonzero(gone != np.r_[False, gone[:-1]])
                starts.append(turns[::2])
                stops.append(turns[1::2])
                data = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()
            sizes.append(len(turns) // 2 if spans else 0)
            kept.append(data)
        bounds = [_long(np.concatenate(x or [np.empty(0, np.int64)])) for x in (starts, stops)]
        lists = pa.ListArray.from_arrays(_int(np.cumsum(sizes)), pa.StructArray.from_arrays(bounds, ["start", "stop"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), lists], names=["doc_id", "kept", "spans"])


def of_text(texts: DataFrame, rows: DataFrame, name: str, how: str) -> DataFrame:
    """texts with an array of (start, count, ...) of each text; rows has one of these per row."""
    fields = [c for c in rows.columns if c not in ("doc_id", "mark")]
    lists = rows.groupBy(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark")).agg(F.collect_list(F.struct(*fields)).alias(name))
    on = texts["doc_id"].eqNullSafe(lists["own_id"]) & (texts["mark"] == lists["own_mark"])
    return texts.join(lists.hint("shuffle_hash"), on, how).select("doc_id", "mark", "body", name)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, kept (the remaining bytes; a cut may fall within a character) and spans (maximal removed runs: start, stop in bytes of the text, ascending)."""
    ship(docs.sparkSession)
    body = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("mark"), body.cast("binary").alias("body"))
    runs = scratch(texts.filter(F.octet_length("body") >= LENGTH).mapInArrow(_runs, RUNS), "runs")
    runs = sorted_flags(runs, ["lead", "anchor", "cover"], ["part", "start"], "sorted-runs")
    spans = ["doc_id", "mark", "start", "count"]
    removed = runs.filter("repeat").select(*spans)

    # Under the anchors where some run stands alone, the bytes of one run of each kind.
    open_ = runs.filter("open").select(*spans, "anchor", (~F.col("repeat")).alias("alone"))
    once = of_text(texts, open_, "runs", "inner")
    keys = ["doc_id", "mark", "start"]
    regions = scratch(once.mapInArrow(_regions, REGIONS).dropDuplicates(keys), "regions")
    blocks = scratch(regions.mapInArrow(_blocks, BLOCKS), "blocks")
    blocks = sorted_flags(blocks, ["lead", "anchor", "core", "cover"], ["doc_id", "mark", "first"], "sorted-blocks", "alone")
    removed = removed.unionByName(blocks.filter("alone and repeat").select("doc_id", "mark", F.col("first").alias("start"), "count"))

    opened = blocks.filter("open").groupBy(*keys).agg(F.collect_list(F.struct("first", "count")).alias("blocks"))
    opened = opened.toDF("o_id", "o_mark", "o_start", "blocks")
    on = regions["doc_id"].eqNullSafe(opened["o_id"]) & (regions["mark"] == opened["o_mark"]) & (regions["start"] == opened["o_start"])
    windows = scratch(regions.join(opened, on).select(*regions.columns, "blocks").mapInArrow(_windows, WINDOWS), "windows")
    windows = sorted_flags(windows, ["lead", "anchor", "window"], ["doc_id", "mark", "start"], "sorted-windows", "alone")
    removed = removed.unionByName(windows.filter("alone and repeat").select(*keys, F.lit(1).alias("count")))
    return of_text(texts, removed, "spans", "left").select("doc_id", "body", "spans").mapInArrow(_cut, CUT)


def report(cut: DataFrame) -> DataFrame:
    """Sizes and digests of what cut_repeats gives: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    rows = cut.select("doc_id", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.octet_length("kept").cast("long").alias("n_kept"), F.sha2("kept", 256).alias("kept_sha256"))
    return rows.select("doc_id", (F.col("n_kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame) -> DataFrame:
    return report(cut_repeats(docs))
