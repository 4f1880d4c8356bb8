"""Plain versions of the operators, text by text, for small inputs."""

import hashlib
from collections import Counter

import numpy as np


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return lower(text).encode().split()


def shingles(text, n=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_components(docs):
    """doc_id to component of {doc_id: text}."""
    sets = {i: shingles(t) for i, t in docs.items()}
    label = {i: i for i in docs}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def repeats(texts, length=400):
    """(bytes, removed, spans, hash of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(d) else 0
        out.append((len(d), int(gone.sum()), spans, sha(np.frombuffer(d, np.uint8)[~gone].tobytes())))
    return out
