"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

1. Every token of every document adds the fixed sparse random vectors of its neighbours (two on either side) to its own row. Rows are hashed
   within the token's shape (lower case, capitalised, upper case, mixed, digits, marks), so their table has a fixed size whatever the
   vocabulary. Sums are whole numbers, hence the same in any order; Spark adds the partitions' tables row by row.
2. Rows are centred and scaled; a document is the mean and the spread of its tokens' rows.
3. A network of one hidden layer learns `quality` from at most about MAX_TRAIN labelled documents, chosen by hash among those whose
   crc32(doc_id) mod 3 is not 1. One in five of them is kept aside to fit the temperature of the probabilities.

Labels, lang, source and doc_id are never inputs. Defined cases: null and blank texts are scored as an empty document; a doc_id with several labels counts by
its largest; labels that are null or without document are ignored; without labels of both kinds the score is the (smoothed) share of label 1; a null doc_id is not
held out; repeated rows get equal scores, and an id on several rows is learned from once (the greatest of its pooled rows); very long texts are pooled piece by piece;
an empty table gives an empty result; further columns pass through the stage, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.session import ship

#: Bound on the labelled rows that the network is fitted on.
MAX_TRAIN = 20_000
DIMS, NONZERO, WINDOW, HIDDEN = 32, 4, 2, 24
#: Rows of the word table by shape of token.
SHAPES = {"lower": 16384, "capital": 4096, "upper": 4096, "mixed": 2048, "digit": 1024, "mark": 2048}
ROWS = sum(SHAPES.values())
#: Tokens handled at a time.
CHUNK = 100_000
#: A worker forgets its tokens' rows when it has so many.
CACHE = 100_000

_FIRST = dict(zip(SHAPES, np.cumsum([0, *SHAPES.values()])))
_token = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def shape(token: str) -> str:
    if not token[0].isalpha():
        return "digit" if token[0].isdigit() else "mark"
    if token.islower():
        return "lower"
    if token.istitle():
        return "capital"
    return "upper" if token.isupper() else "mixed"


class _Rows(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        kind = shape(token)
        self[token] = out = int(_FIRST[kind] + zlib.crc32(token.encode("utf-8", "surrogatepass")) % SHAPES[kind])
        return out


_rows = _Rows()


def token_rows(text: str | None) -> np.ndarray:
    found = _token.findall(text or "")
    return np.fromiter(map(_rows.__getitem__, found), np.uint16, len(found))


def index_vectors() -> np.ndarray:
    """Row r's own random vector: NONZERO entries, half of them 1 and half -1; the last row (no token) is zero."""
    rng = np.random.default_rng(20240601)
    out = np.zeros((ROWS + 1, DIMS), np.int8)
    places = rng.random((ROWS, DIMS)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(out[:ROWS], places, np.tile([1, -1], NONZERO // 2).astype(np.int8)[None, :], axis=1)
    return out


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, table, seen = index_vectors(), np.zeros((ROWS, DIMS), np.int64), np.zeros(ROWS, np.int64)
    gap = np.full(WINDOW, ROWS, np.uint16)

    def add(parts: list[np.ndarray]) -> None:
        flat = np.concatenate([gap, *parts])
        for start in range(WINDOW, len(flat) - WINDOW, CHUNK):
            stop = min(start + CHUNK, len(flat) - WINDOW)
            own = flat[start:stop]
            near = np.zeros((stop - start, DIMS), np.int16)
            for k in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
                near += index[flat[start + k : stop + k]]
            order = np.argsort(own, kind="stable")
            rows, first, counts = np.unique(own[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
            real = rows < ROWS
            table[rows[real]] += sums[real]
            seen[rows[real]] += counts[real]

    parts, held = [], 0
    for batch in batches:
        for text in batch.column(0):
            rows = token_rows(text.as_py())
            parts += [rows, gap]
            held += len(rows)
            if held >= CHUNK:
                add(parts)
                parts, held = [], 0
    if parts:
        add(parts)
    _rows.clear()
    used = np.flatnonzero(seen)
    columns = [pa.array(used.astype(np.int32)), pa.array(seen[used]), *[pa.array(table[used, d]) for d in range(DIMS)]]
    yield pa.RecordBatch.from_arrays(columns, names=["row", "seen", *[f"v{d}" for d in range(DIMS)]])


def word_table(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all rows (float32; the last row, for no token, is zero). What is collected has ROWS rows at most."""
    names = [f"v{d}" for d in range(DIMS)]
    parts = docs.select("text").mapInArrow(_context_sums, "row int, seen long, " + ", ".join(f"{x} long" for x in names))
    sums = parts.groupBy("row").agg(*[F.sum(x).alias(x) for x in ["seen", *names]]).toPandas()
    out = np.zeros((ROWS + 1, DIMS))
    if len(sums):
        v, seen = sums[names].to_numpy(np.float64), sums["seen"].to_numpy(np.float64)
        v = v / seen[:, None] - v.sum(axis=0) / seen.sum()
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        out[sums["row"].to_numpy()] = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    return out.astype(np.float32)


def pooled(texts: Iterator[str | None], n: int, table: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the token vectors of each of n texts."""
    sums, squares, counts = np.zeros((n, DIMS)), np.zeros((n, DIMS)), np.zeros(n)

    def add(rows: np.ndarray, docs: np.ndarray) -> None:
        for at in range(0, len(rows), CHUNK):
            vectors, own = table[rows[at : at + CHUNK]], docs[at : at + CHUNK]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            sums[own[first]] += np.add.reduceat(vectors, first, axis=0, dtype=np.float64)
            squares[own[first]] += np.add.reduceat(vectors * vectors, first, axis=0, dtype=np.float64)

    parts, ids, held = [], [], 0
    for i, text in enumerate(texts):
        rows = token_rows(text)
        counts[i] = len(rows)
        if len(rows):
            parts.append(rows)
            ids.append(i)
            held += len(rows)
        if held >= CHUNK:
            add(np.concatenate(parts), np.repeat(ids, [len(p) for p in parts]))
            parts, ids, held = [], [], 0
    if parts:
        add(np.concatenate(parts), np.repeat(ids, [len(p) for p in parts]))
    count = np.maximum(counts, 1)[:, None]
    mean = sums / count
    return np.hstack([mean, np.sqrt(np.maximum(squares / count - mean * mean, 0))])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """Standardised input, one hidden layer of rectified units, a logit, and the temperature that divides it."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        # Rounded, as sums of a matrix product may differ in the last place from batch to batch.
        return np.round(sigmoid(self.logit(x) / self.temperature), 9)


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on the cross entropy of four fifths of the rows; the temperature is fitted on the rest."""
    aside = np.arange(len(y)) % 5 == 0
    if len(set(y[~aside])) < 2 or not aside.any():
        share = (y.sum() + 1) / (len(y) + 2)
        d = x.shape[1] if x.ndim == 2 else 2 * DIMS
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(7)
    tx, ty = x[~aside], y[~aside].astype(float)
    centre, scale = tx.mean(axis=0), tx.std(axis=0) + 1e-6
    z = (tx - centre) / scale
    p = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(ty))
        for at in range(0, len(ty), batch):
            some = order[at : at + batch]
            a, b = z[some], ty[some]
            h = np.maximum(a @ p[0] + p[1], 0)
            e = (sigmoid(h @ p[2] + p[3]) - b) / len(b)
            back = np.outer(e, p[2]) * (h > 0)
            grads = [a.T @ back + decay * p[0], back.sum(axis=0), h.T @ e + decay * p[2], e.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]))
    logits, truth = net.logit(x[aside]), y[aside].astype(float)
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
    loss = [np.mean(np.logaddexp(0, logits / g) - truth * logits / g) for g in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, Network]:
    """The word table of all docs, and the network."""
    ship(docs.sparkSession)
    table = word_table(docs)
    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max("quality").alias("y"))
    known = known.filter(~held_out(F.col("key")))
    share = min(1.0, max_train / max(known.count(), 1))
    some = known.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # At most about max_train ids, by the filter above. Columns are taken from docs before the join: docs may have a key or y of its own.
    own = docs.select(F.col("doc_id").alias("own_id"), F.col("text").alias("own_text"))
    rows = own.join(F.broadcast(some), F.col("own_id") == F.col("key")).select("key", F.col("y").cast("int").alias("y"), "own_text")
    kept = docs.sparkSession.sparkContext.broadcast(table)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pooled((t.as_py() for t in b.column(2)), len(b), kept.value)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * 2 * DIMS), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["key", "y", "x"])

    # One row an id, whatever number of rows has it, so what is collected stays within max_train or so.
    each = rows.mapInArrow(pool, "key long, y int, x array<double>").groupBy("key").agg(F.max(F.struct("y", "x")).alias("best"))
    got = each.select("key", "best.y", "best.x").toPandas().sort_values(["key"], kind="stable")
    x = np.array(got["x"].tolist()) if len(got) else np.zeros((0, 2 * DIMS))
    order = np.random.default_rng(11).permutation(len(got))
    return table, fit(x[order], got["y"].to_numpy()[order])


def scorer(docs: DataFrame, table: np.ndarray, net: Network):
    """A function of a text column: the probability of label 1."""
    kept = docs.sparkSession.sparkContext.broadcast((table, net))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        words, network = kept.value
        return pa.array(network.score(pooled((t.as_py() for t in texts), len(texts), words)))

    return score


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = scorer(docs, *train(docs, labels))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with predicted = 1; docs' columns. Nothing is shuffled."""
    score = scorer(docs, *train(docs, labels))
    return docs.filter(score(docs["text"]) >= 0.5)
