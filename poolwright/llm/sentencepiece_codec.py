"""SentencePiece encoding by sampled segmentations without replacement, and decoding.

The lattice of a text has an edge for every piece that matches at a position; characters without a piece go through byte pieces. A piece's probability falls with its
rank in the vocabulary (1 / (rank + 10), scaled), and backward sums turn the lattice into a chain of choices whose
probabilities multiply to the share of each segmentation. No piece spans a blank's left side or a line feed, so the lattice is a series of short
chunks, each of which is built once for all texts that are sampled together.

Gumbel top-k: the root gets a Gumbel value, and a child set's best value is a Gumbel of its log mass cut off at its parent's. The search always
opens the set with the best value. Its first path is an ordinary sample; the sets that leave this path at each later choice join
the queue, and the best of them gives the next path. So k paths come out in order of their perturbed values, all different, and the value that would have come next is
the threshold of the inclusion score 1 - exp(-exp(log p - threshold)), returned as its logarithm.

Every random number is a hash of the row's key, the path, the chunk and the choice: a row's samples depend on nothing else.

Defined cases: null and empty texts have one segmentation, without pieces; a text with fewer than k segmentations has fewer rows, of inclusion 1; rows that repeat a key repeat
its samples; a null key is a key; an empty table gives an empty result; the text may hold the blank mark itself, which then goes through
bytes; further columns are dropped by encode() and never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwright.llm.shingles import mix
from poolwright.session import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
SAMPLES = 2
SEED = 1234
#: Characters of text that are sampled together.
GROUP = 600_000
_chunk = re.compile(" *[^ \n]+| +|\n")
_ODD, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def read_pieces(path: str = MODEL) -> list[tuple[str, int]]:
    """The model's pieces in order of id, each with its kind: 0 a normal piece, 1 a byte, 2 anything else. Read by the driver alone."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 1 if model.is_byte(i) else 2 * (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    return [(model.id_to_piece(i), kind(i)) for i in range(model.get_piece_size())]


class Vocabulary:
    """Pieces, their probabilities, and a hash table of all their prefixes."""

    def __init__(self, pieces: list[tuple[str, int]]):
        normal = [(p.replace(BLANK, " "), i) for i, (p, kind) in enumerate(pieces) if kind == 0]
        self.size = len(pieces)
        self.weight = np.zeros(self.size)
        rank = 1 / (np.arange(len(normal)) + 10.0)
        self.weight[[i for _, i in normal]] = rank / rank.sum()
        self.byte = {int(p[3:5], 16): i for i, (p, kind) in enumerate(pieces) if kind == 1}
        self.byte_weight = float(self.weight[self.weight > 0].min())
        back = {i: bytes([b]) for b, i in self.byte.items()} | {i: p.encode() for p, i in normal}
        self.bytes = [back.get(i, b"") for i in range(self.size)]
        self.longest = max((len(p) for p, _ in normal), default=1)
        ids = dict(normal)
        prefixes = sorted({p[:k] for p in ids for k in range(1, len(p) + 1)})
        self._table({self.hash(p): ids.get(p, -1) for p in prefixes})

    @staticmethod
    def hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & ((1 << 64) - 1)
        return h

    def _table(self, found: dict[int, int]) -> None:
        bits = max(4, (4 * len(found)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values, self.probes = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -2, np.int32), 1
        for h, value in found.items():
            slot, n = ((h * int(_ODD)) & ((1 << 64) - 1)) >> int(self.shift), 1
            while self.keys[slot]:
                slot, n = (slot + 1) & ((1 << bits) - 1), n + 1
            self.keys[slot], self.values[slot], self.probes = h, value, max(n, self.probes)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each prefix hash; -1: a prefix of pieces only; -2: neither."""
        slot = ((hashes * _ODD) >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == hashes, self.values[slot], -2)
        open_ = np.flatnonzero((out == -2) & (self.keys[slot] != 0))
        for k in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + k) & (len(self.keys) - 1)
            hit = self.keys[at] == hashes[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.keys[at] != 0)]
        return out

    def spelled(self, ids) -> bytes:
        """UTF-8 bytes of piece ids. The blank that encoding puts first goes."""
        return b"".join(map(self.bytes.__getitem__, ids)).removeprefix(b" ")

    def decode(self, ids) -> str:
        return self.spelled(ids).decode("utf-8", "replace")


class Lattice:
    """The lattices of some chunks side by side. State 1 + i is position i of the joined chunks, state 0 the end of any chunk.

    Arrays by choice: to (state), id (piece; from vocabulary.size on: a character spelled in bytes), q (probability), upto (sum of q within the state,
    the last one lifted to 2), of (state). Arrays by state: at and end (its choices).
    """

    def __init__(self, vocabulary: Vocabulary, chunks: list[str]):
        lengths = np.array([len(c) for c in chunks], np.int64)
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        n, ends = len(points), np.repeat(np.cumsum(lengths), lengths)
        self.start = np.cumsum(lengths) - lengths + 1
        active, h = np.arange(n), np.zeros(n, np.uint64)
        sources, spans, pieces = [], [], []
        for k in range(1, vocabulary.longest + 1):
            fits = active + k <= ends[active]
            active, h = active[fits], h[fits]
            if not len(active):
                break
            h = h * _BASE + points[active + k - 1]
            found = vocabulary.lookup(h)
            hit = found >= 0
            sources.append(active[hit])
            spans.append(np.full(int(hit.sum()), k))
            pieces.append(found[hit].astype(np.int64))
            if k == 1:
                spelled = active[~hit]
            active, h = active[found >= -1], h[found >= -1]
        weights = [vocabulary.weight[p] for p in pieces]
        self.spelled: list[list[int]] = []
        if len(spelled):
            kinds, which = np.unique(points[spelled], return_inverse=True)
            self.spelled = [[vocabulary.byte[b] for b in chr(int(c) - 1).encode("utf-8", "surrogatepass")] for c in kinds]
            sources.append(spelled)
            spans.append(np.ones(len(spelled), np.int64))
            pieces.append(vocabulary.size + which)
            weights.append(np.array([vocabulary.byte_weight ** len(x) for x in self.spelled])[which])
        source, span, piece, weight = map(np.concatenate, (sources, spans, pieces, weights))
        # From the chunks' ends backwards; within a state long pieces first, as they are the likely ones.
        left = ends[source] - source
        order = np.argsort((left << np.int64(40)) + (source << np.int64(6)) - span, kind="stable")
        source, span, left = source[order], span[order], left[order]
        self.id, self.q = piece[order].astype(np.int32), weight[order]
        # One byte is a piece like others; longer spellings stay apart until a path is written out.
        single = np.array([x[0] if len(x) == 1 else vocabulary.size + k for k, x in enumerate(self.spelled)], np.int32)
        apart = self.id >= vocabulary.size
        self.id[apart] = single[self.id[apart] - vocabulary.size]
        self.vocabulary_size, self.long_spelled = vocabulary.size, any(len(x) > 1 for x in self.spelled)
        target = source + span
        first = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
        count = np.diff(np.r_[first, len(source)])
        self.at, self.end = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.at[source[first] + 1], self.end[source[first] + 1] = first, first + count
        self.to, self.of = np.where(target == ends[source], 0, target + 1).astype(np.int32), (source + 1).astype(np.int32)
        beta = np.ones(n + 1)
        last = np.where(self.to == 0, n, target)
        levels = np.r_[np.flatnonzero(np.r_[True, left[1:] != left[:-1]]), len(left)]
        state_level = np.searchsorted(first, levels)
        for k in range(len(levels) - 1):
            low, high = levels[k], levels[k + 1]
            states = first[state_level[k] : state_level[k + 1]]
            value = self.q[low:high] * beta[last[low:high]]
            total = np.add.reduceat(value, states - low)
            self.q[low:high] = value / np.repeat(total, count[state_level[k] : state_level[k + 1]])
            beta[source[states]] = total
            for i in source[states[total < 1e-150]]:
                # Only ratios within a piece's reach matter from here on.
                beta[i : min(i + vocabulary.longest + 1, ends[i])] *= 1e150
        # Summed state by state, so that a sum does not depend on what else is in the lattice.
        self.upto = self.q.copy()
        for k in range(1, int(count.max(initial=1))):
            nth = first[count > k] + k
            self.upto[nth] += self.upto[nth - 1]
        self.upto[first + count - 1] = 2.0
        self.only = np.zeros(len(source), bool)
        self.only[first[count == 1]] = True

    def spell(self, choices: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of rows of choices, characters without a piece spelled out, and where each row ends."""
        out = self.id[choices]
        if not self.long_spelled:
            return out, ends
        sizes = np.r_[np.ones(self.vocabulary_size, np.int64), [len(x) for x in self.spelled]][out]
        spread, place = np.repeat(out, sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(spread >= self.vocabulary_size)
        letters = np.zeros((len(self.spelled), 4), np.int32)
        for k, x in enumerate(self.spelled):
            letters[k, : len(x)] = x
        spread[at] = letters[spread[at] - self.vocabulary_size, place[at]]
        return spread, np.r_[0, np.cumsum(sizes)][ends]


def uniform(keys: np.ndarray, count) -> np.ndarray:
    """Numbers in (0, 1) from hashed keys."""
    return ((mix(keys ^ (np.atleast_1d(np.asarray(count, np.uint64)) + np.uint64(1)) * _ODD) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def walk(lattice: Lattice, start: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sample a path from each state to its chunk's end: choices, chunk after chunk, and their number in each chunk."""
    who = np.flatnonzero(start)
    state, steps = start[who], []
    counts = np.zeros(len(start), np.int64)
    while len(who):
        u = uniform(keys[who], len(steps))
        t = lattice.at[state]
        more = np.flatnonzero(u >= lattice.upto[t])
        while len(more):
            t[more] += 1
            more = more[u[more] >= lattice.upto[t[more]]]
        steps.append((who, t))
        counts[who] += 1
        state = lattice.to[t]
        going = np.flatnonzero(state)
        who, state = who[going], state[going]
    out = np.empty(int(counts.sum()), np.int64)
    offset = np.cumsum(counts) - counts
    for k, (who, t) in enumerate(steps):
        out[offset[who] + k] = t
    return out, counts


def truncated(mass: np.ndarray, bound, u: np.ndarray) -> np.ndarray:
    """Gumbel values of the given log mass, given that they are below bound."""
    with np.errstate(divide="ignore", over="ignore"):
        return mass - np.log(np.exp(mass - bound) - np.log(u))


class _Path:
    """One path of every row: choices, the chunk of each, where rows start, the value of the set that leaves at each choice."""

    def __init__(self, t: np.ndarray, chunk: np.ndarray, ends: np.ndarray):
        self.t, self.chunk, self.ends = t, chunk, ends
        self.starts = np.r_[0, ends[:-1]]

    def value(self, lattice: Lattice, best: np.ndarray, open_from: np.ndarray, keys: np.ndarray, salt: int) -> None:
        counts = self.ends - self.starts
        row = np.repeat(np.arange(len(counts)), counts)
        q = lattice.q[self.t]
        log_q = np.log(q)
        with np.errstate(divide="ignore"):
            log_rest = np.where(lattice.only[self.t], -np.inf, np.log(np.maximum(1 - q, 0)))
        # Summed row by row, for the same result whatever rows are sampled together.
        self.before, self.log_p = np.zeros(len(row)), np.zeros(len(counts))
        for i in np.flatnonzero(counts):
            total = np.cumsum(log_q[self.starts[i] : self.ends[i]])
            self.before[self.starts[i] + 1 : self.ends[i]] = total[:-1]
            self.log_p[i] = total[-1]
        place = np.arange(len(row)) - self.starts[row]
        mass = np.where(place >= open_from[row], self.before + log_rest, -np.inf)
        self.rest = truncated(mass, best[row], uniform(keys[row] ^ np.uint64(salt), place))

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Best value of each row, and where it is."""
        n = len(self.ends)
        top, at = np.full(n, -np.inf), np.zeros(n, np.int64)
        some = np.flatnonzero(self.ends > self.starts)
        if len(some):
            top[some] = np.maximum.reduceat(self.rest, self.starts[some])
            row = np.repeat(np.arange(n), self.ends - self.starts)
            hit = np.flatnonzero((self.rest == top[row]) & (self.rest > -np.inf))
            rows, first = np.unique(row[hit], return_index=True)
            at[rows] = hit[first]
        return top, at


def sample(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, float, float]]:
    """(row, rank from 1, piece ids, log probability, log inclusion) of up to k segmentations of each text."""
    n = len(texts)
    chunks = [_chunk.findall(" " + t) if t else [] for t in texts]
    kinds = {c: i for i, c in enumerate(dict.fromkeys(chain.from_iterable(chunks)))}
    sizes = np.array([len(c) for c in chunks], np.int64)
    which = np.fromiter(map(kinds.__getitem__, chain.from_iterable(chunks)), np.int64, int(sizes.sum()))
    if not kinds:
        yield from ((i, 1, np.empty(0, np.int32), 0.0, 0.0) for i in range(n))
        return
    lattice = Lattice(vocabulary, list(kinds))
    start = lattice.start[which]
    chunk_end = np.cumsum(sizes)
    row_of = np.repeat(np.arange(n), sizes)
    within = (np.arange(len(start)) - (chunk_end - sizes)[row_of]).astype(np.uint64)
    chunk_keys = mix(keys[row_of] ^ mix(within + np.uint64(1)))
    t, counts = walk(lattice, start, chunk_keys)
    per_row = np.r_[0, np.cumsum(counts)][chunk_end]
    first = _Path(t, np.repeat(np.arange(len(start)), counts), per_row)
    value = -np.log(-np.log(uniform(keys, 7)))
    first.value(lattice, value, np.zeros(n, np.int64), keys, 1)
    paths, alive = [first], [np.ones(n, bool)]
    taken: list[dict[int, list[int]]] = [{}]
    for r in range(1, k + 1):
        tops, places = zip(*[p.best() for p in paths])
        source = np.argmax(np.stack(tops), axis=0)
        value = np.stack(tops)[source, np.arange(n)]
        if r == k:
            break
        alive.append(value > -np.inf)
        heads, tails, tail_keys, chunk_heads, chunk_tails = [], [], [], [], []
        for i in range(n):
            if value[i] == -np.inf:
                heads.append((np.empty(0, np.int64), np.empty(0, np.int64)))
                continue
            p, at = paths[source[i]], int(places[source[i]][i])
            used = taken[source[i]].setdefault(at, [int(p.t[at])])
            state = int(lattice.of[p.t[at]])
            free = np.array([x for x in range(lattice.at[state], lattice.end[state]) if x not in used])
            weight = np.cumsum(lattice.q[free])
            u = float(uniform(keys[i : i + 1] ^ np.uint64(100 + r), at - p.starts[i])[0])
            pick = int(free[min(int(np.searchsorted(weight, u * weight[-1], side="right")), len(free) - 1)])
            used.append(pick)
            left = weight[-1] - lattice.q[pick]
            mass = p.before[at] + np.log(left) if len(free) > 1 and left > 0 else -np.inf
            p.rest[at] = truncated(np.array([mass]), value[i], uniform(keys[i : i + 1] ^ np.uint64(200 + r), at - p.starts[i]))[0]
            c = int(p.chunk[at])
            heads.append((np.r_[p.t[p.starts[i] : at], pick], p.chunk[p.starts[i] : at + 1]))
            tails.append(np.r_[lattice.to[pick], start[c + 1 : chunk_end[i]]])
            chunk_tails.append(np.arange(c, chunk_end[i]))
        tail = np.concatenate(tails) if tails else np.empty(0, np.int64)
        tail_chunk = np.concatenate(chunk_tails) if tails else np.empty(0, np.int64)
        suffix, counts = walk(lattice, tail, mix(chunk_keys[tail_chunk] ^ np.uint64(r)))
        suffix_chunk = np.repeat(tail_chunk, counts)
        cut = np.r_[0, np.cumsum(counts)][np.cumsum([len(x) for x in tails])] if tails else np.empty(0, np.int64)
        parts, part_chunks, ends, open_from, j, total = [], [], [], [], 0, 0
        for i in range(n):
            head, head_chunk = heads[i]
            open_from.append(len(head))
            parts.append(head)
            part_chunks.append(head_chunk)
            total += len(head)
            if value[i] > -np.inf:
                low, high = (cut[j - 1] if j else 0), cut[j]
                parts.append(suffix[low:high])
                part_chunks.append(suffix_chunk[low:high])
                total += high - low
                j += 1
            ends.append(total)
        path = _Path(np.concatenate(parts), np.concatenate(part_chunks), np.array(ends, np.int64))
        path.value(lattice, value, np.array(open_from), keys, 1 + r)
        paths.append(path)
        taken.append({})
    written = [lattice.spell(p.t, p.ends) for p in paths]
    for i in range(n):
        for r, p in enumerate(paths):
            if alive[r][i]:
                gap = p.log_p[i] - value[i] if value[i] > -np.inf else np.inf
                inclusion = gap if gap < -30 else float(np.log(-np.expm1(-np.exp(min(gap, 50)))))
                ids, ends = written[r]
                yield i, r + 1, ids[ends[i - 1] if i else 0 : ends[i]], float(p.log_p[i]), float(inclusion)


RESULT = "doc_id long, sample int, n_pieces long, log_prob double, log_inclusion double, ids array<int>, decoded_sha256 string"


def _encoder(kept, k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = kept.value

        def flush(ids: list, texts: list[str]) -> pa.RecordBatch:
            keys = mix(np.array([(x if x is not None else -1) & ((1 << 64) - 1) for x in ids], np.uint64) ^ np.uint64(seed))
            doc, rank, pieces, log_p, inclusion, sha = [], [], [], [], [], []
            for i, r, out, p, q in sample(vocabulary, texts, keys, k):
                doc.append(ids[i])
                rank.append(r)
                pieces.append(out)
                log_p.append(p)
                inclusion.append(q)
                sha.append(hashlib.sha256(vocabulary.spelled(out.tolist())).hexdigest())
            sizes = np.array([len(x) for x in pieces], np.int64)
            flat = pa.array(np.concatenate(pieces) if pieces else np.empty(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat)
            columns = [pa.array(doc, pa.int64()), pa.array(rank, pa.int32()), pa.array(sizes), pa.array(log_p), pa.array(inclusion), lists, pa.array(sha, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "sample", "n_pieces", "log_prob", "log_inclusion", "ids", "decoded_sha256"])

        for batch in batches:
            ids, texts, held = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                ids.append(key.as_py())
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= GROUP:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield flush(ids, texts)

    return run


def encode(docs: DataFrame, k: int = SAMPLES, model: str = MODEL, seed: int = SEED) -> DataFrame:
    """Up to k sampled segmentations of each text, with the hash of what they decode to. Narrow: nothing is shuffled."""
    ship(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_pieces(model)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(kept, k, seed), RESULT)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded (with a column ids) and the text of its pieces; null ids give null."""
    ship(encoded.sparkSession)
    kept = encoded.sparkSession.sparkContext.broadcast(Vocabulary(read_pieces(model)))

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else kept.value.decode(x.tolist()))

    return encoded.withColumn("text", text("ids"))
