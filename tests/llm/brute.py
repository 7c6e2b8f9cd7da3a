"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import xxhash


def words(text):
    return (text or "").encode().split()


def print_of(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    count = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for j in range(64):
            count[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * count[j] > len(grams))


def components(n, linked):
    """Smallest index reachable, for pairs (i, j)."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in linked:
        a, b = top(i), top(j)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def removed_bytes(texts, window):
    """Per text: bytes, removed, spans, digest."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s : s + window] for d in data for s in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - window + 1):
            if seen[d[s : s + window]] > 1:
                gone[s : s + window] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removed_words(rows, window):
    """rows: (id or None, text). Per row: words, removed, digest."""
    key = lambda i: -(2**63) if i is None else i
    first = {}
    data = [(key(i), words(t)) for i, t in rows]
    for i, w in data:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in data:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone[s : s + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def jaccard(a, b, n=5):
    def grams(t):
        w = [x.lower() for x in words(t)]
        return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    x, y = grams(a), grams(b)
    return 1.0 if not x and not y else len(x & y) / len(x | y)
