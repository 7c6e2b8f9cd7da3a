"""Exact removal of repeated byte strings with sorted suffixes.

The suffixes that stand for all others start at minimisers: each block of
windows (see repeats.py) is a suffix at its minimiser plus the bytes before it.
Sampled splitters range-partition these suffixes by their leading bytes. A
bucket sorts its suffixes by multikey quicksort, forwards from the minimiser
and backwards from it, and the common prefixes of neighbours in both orders
tell exactly which windows are equal. Equal leading bytes are never divided by
a splitter, so neighbours across a bucket's boundary share fewer bytes than a
minimiser has; an anchor with too many different blocks for one task leaves the
buckets, and its windows are compared across tasks by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
import sys
import types

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .common import as_bytes, doc_id, drop, keyed, packed_texts, sent_if_small, table, unpack

WINDOW, GRAM, LEAD = 400, 64, 64
#: The shorter window whose repeats are reported beside the removals: a passage of over 50 words may have fewer than 400 bytes.
SHORT = 256
#: Windows of a very long text that are looked at together.
STRETCH = 1 << 20
#: Segments of at most so many suffixes are sorted by whole keys.
SMALL = 24
#: Suffixes that a bucket sorts together, at least; and different ones with one anchor, at most: beyond it their windows are dealt one by one. A suffix takes about 2 KB.
TOGETHER, RIVALS = 4096, 8192


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, kept by the worker."""
    kept = sys.modules.setdefault("_larkspan_powers", types.ModuleType("_larkspan_powers")).__dict__
    if base not in kept or len(kept[base][0]) < n:
        size = max(n, 1 << 17)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        kept[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return kept[base]


def rolling(data: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each k bytes of data."""
    up, down = _powers(base, len(data) + 1)
    coded = R.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(coded[data] * up[: len(data)], out=total[1:])
    return R.mixed((total[k:] - total[:-k]) * down[: len(data) - k + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values, by running minima of blocks in both directions."""
    n = len(x)
    whole = -(-n // width) * width
    padded = np.full(whole, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def blocks(data: np.ndarray, window: int, gram: int):
    """anchor, minimiser's place, first window, count of windows; stretch by stretch, for texts of at least `window` bytes."""
    for base in range(0, len(data) - window + 1, STRETCH):
        part = data[base : base + STRETCH + window - 1]
        g = rolling(part, gram)
        low = np.uint64((1 << int(len(g)).bit_length()) - 1)
        least = sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), window - gram + 1)
        at = (least & low).astype(np.int64)
        first, count = R.run_starts(at)
        yield g[at[first]], at[first] + base, first + base, count


def _describe(window: int, gram: int, packed: bool):
    """Blocks of texts: did, tk, text or, packed, did, tk, n_bytes, z."""

    def run(batches):
        for b in R.sliced(batches):
            out: list = [[], [], [], [], []]
            texts = (unpack(z, n) for n, z in zip(b.column(2).to_pylist(), b.column(3).to_pylist())) if packed else as_bytes(b.column(2))
            for did, tk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts):
                if len(text) < window:
                    continue
                for anchor, _, first, count in blocks(np.frombuffer(text, np.uint8), window, gram):
                    same = np.fromiter([xxhash.xxh3_64_intdigest(text[a : a + c + window - 1]) for a, c in zip(first.tolist(), count.tolist())], np.uint64, len(first))
                    for x, y in zip(out, (anchor, same, np.full(len(first), did, np.int64), np.full(len(first), tk, np.int64), R.packed_loc(first, count))):
                        x.append(y)
            yield R.meta_batch(*out)

    return run


PACKED = "lead binary, anchor long, did long, tk long, loc long, off int, packed binary, hot boolean"


def _pack(window: int, gram: int):
    """The asked-for blocks of a document; those with a hot anchor as two hashes (lead and anchor) of each window."""

    def run(batches):
        for b in R.sliced(batches):
            out: list = [[] for _ in range(8)]
            for did, tk, n, z, asked in zip(*(c.to_pylist() for c in b.columns)):
                text = unpack(z, n)
                data = np.frombuffer(text, np.uint8)
                place = {}
                for _, at, first, _ in blocks(data, window, gram):
                    place.update(zip(first.tolist(), at.tolist()))
                twin = [rolling(data, window, base) for base in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)] if any(x["hot"] for x in asked) else []
                for x in asked:
                    at, count = (int(v[0]) for v in R.unpacked_loc(np.array([x["loc"]])))
                    if x["hot"]:
                        s = np.arange(at, at + count)
                        loc = R.packed_loc(s, np.ones_like(s)).tolist()
                        rows = zip([v.tobytes() for v in twin[0][s]], twin[1][s].view(np.int64).tolist(), [did] * count, [tk] * count, loc, [0] * count, [b""] * count, [True] * count)
                    else:
                        p = place[at]
                        rows = [(text[p : p + min(LEAD, gram)], x["anchor"], did, tk, x["loc"], p - at, text[at : at + count + window - 1], False)]
                    for row in rows:
                        for o, v in zip(out, row):
                            o.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=[c.split()[0] for c in PACKED.split(", ")])

    return run


def multikey_quicksort(rows: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix: three-way partitions by eight bytes at a time, equal parts going on with the next eight."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    keys = [r.tobytes() for r in rows]
    order: list = []
    todo = [(np.arange(len(rows)), 0)]
    while todo:
        part, depth = todo.pop()
        if len(part) <= SMALL or depth == words.shape[1]:
            order += sorted(part.tolist(), key=keys.__getitem__)
            continue
        c = words[part, depth]
        pivot = np.sort(c[[0, len(c) // 2, -1]])[1]
        todo += [(part[c > pivot], depth), (part[c == pivot], depth + 1), (part[c < pivot], depth)]
    return np.array(order, np.int64)


def neighbours(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it in order; the first has 0."""
    s = rows[order]
    differ = s[1:] != s[:-1]
    return np.append(0, np.where(differ.any(1), differ.argmax(1), rows.shape[1]))


def equal_windows(packed: list[bytes], off: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """[i, o]: window of block i that starts o bytes before its minimiser equals such a window of another block."""
    n, width = len(packed), -(-window // 8) * 8
    ahead, back = np.zeros((n, width), np.uint8), np.zeros((n, width), np.uint8)
    for i, (x, o) in enumerate(zip(packed, off.tolist())):
        a = np.frombuffer(x, np.uint8)
        ahead[i, : len(a) - o] = a[o:][:width]
        back[i, :o] = a[:o][::-1]
    order_a, order_b = multikey_quicksort(ahead), multikey_quicksort(back)
    near_a, near_b = neighbours(ahead, order_a), neighbours(back, order_b)
    low, high = off - count + 1, off
    hit = np.zeros((n, window), bool)
    group_a, group_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(int(low.min()), int(high.max()) + 1):
        busy = np.flatnonzero((low <= o) & (o <= high))
        if len(busy) < 2:
            continue
        group_a[order_a] = np.cumsum(near_a < window - o)
        group_b[order_b] = np.cumsum(near_b < o) if o else 0
        key = group_a[busy] * (n + 1) + group_b[busy]
        by = np.argsort(key, kind="stable")
        twin = key[by][1:] == key[by][:-1]
        hit[busy[by[1:][twin]], o] = hit[busy[by[:-1][twin]], o] = True
    return hit


def _sort(window: int):
    """Over rows sorted by lead: the windows of each block that equal a window of another."""

    def run(batches):
        for t in R.whole_groups(batches, 0, TOGETHER):
            did, tk, loc, off = (t.column(i).to_numpy() for i in (2, 3, 4, 5))
            at, count = R.unpacked_loc(loc)
            hit = equal_windows(t.column(6).to_pylist(), off.astype(np.int64), count, window)
            out: list = [[], [], [], []]
            for i in np.flatnonzero(hit.any(1)):
                mask = hit[i, off[i] - count[i] + 1 : off[i] + 1][::-1]  # by rising start
                for s, n in R.mask_runs(mask):
                    for o, v in zip(out, (did[i], tk[i], at[i] + s, n)):
                        o.append(v)
            yield R.hit_batch(*out)

    return run


def repeated_windows(packed_text: DataFrame, plain: DataFrame | None, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """did, tk, at, n: runs of windows whose bytes also start elsewhere. packed_text: as of packed_texts(); plain: the same as of keyed(), where that is read from its source."""
    shared = R.shared_blocks((packed_text if plain is None else plain).mapInArrow(_describe(window, gram, plain is None), R.META))
    kinds = R.classes(shared)
    copies = R.with_class(shared, kinds.where("n > 1")).select("did", "tk", F.expr(R.AT), F.expr(R.COUNT))
    packed = table(packed_text.join(R.rivals(kinds, RIVALS), ["did", "tk"]).select("did", "tk", "n_bytes", "z", "blocks").mapInArrow(_pack(window, gram), PACKED), "packed")
    cold = packed.where("NOT hot").repartitionByRange("lead").sortWithinPartitions("lead").mapInArrow(_sort(window), R.HITS)
    hot = packed.where("hot").select("lead", "anchor", "did", "tk", F.expr(R.AT))
    twice = table(hot.groupBy("lead", "anchor").agg(F.count("*").alias("k")).where("k > 1").select("lead", "anchor"), "windows")
    dealt = hot.join(sent_if_small(twice), ["lead", "anchor"]).select("did", "tk", "at", F.lit(1).alias("n"))
    hits = table(copies.unionByName(cold).unionByName(dealt), "hits")
    drop(shared, kinds, packed, twice)
    return hits


MARKED = "did long, tk long, n_bytes long, z binary, n_repeated long, longest long"


def _mark(window: int):
    """Bytes covered by the hits of each text, and the longest run of them."""

    def run(batches):
        for b in R.sliced(batches):
            n_bytes, starts, counts = (b.column(k).to_pylist() for k in (2, 4, 5))
            gone, longest = [], []
            for n, s, c in zip(n_bytes, starts, counts):
                out = R.covered(np.array(s, np.int64), np.array(c, np.int64), window, n) if s else np.zeros(0, bool)
                gone.append(int(out.sum()))
                longest.append(max((k for _, k in R.mask_runs(out)), default=0))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(gone, pa.int64()), pa.array(longest, pa.int64())], names=[c.split()[0] for c in MARKED.split(", ")])

    return run


CUT = "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long"


def _cut(window: int):
    def run(batches):
        for b in R.sliced(batches):
            n_bytes, z, starts, counts = (b.column(k).to_pylist() for k in (1, 2, 4, 5))
            gone, spans, digest = [], [], []
            for n, packed, s, c in zip(n_bytes, z, starts, counts):
                text = unpack(packed, n)
                if s:
                    out = R.covered(np.array(s, np.int64), np.array(c, np.int64), window, n)
                    gone.append(int(out.sum()))
                    spans.append(len(R.mask_runs(out)))
                    text = np.frombuffer(text, np.uint8)[~out].tobytes()
                else:
                    gone.append(0)
                    spans.append(0)
                digest.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), b.column(3)], names=[c.split()[0] for c in CUT.split(", ")])

    return run


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, short: int = SHORT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated of every row of docs.

    A byte goes if a string of `window` bytes that covers it also starts
    anywhere else, in the same row or another; each row is a document of its
    own, whatever its id, so repeated rows lose all they share. n_repeated
    counts the bytes covered by a string of `short` bytes, at most `window`,
    that also starts anywhere else, kept or not. Texts that are null, empty or
    shorter than a window lose nothing; no rows give no rows.

    Where `window` bytes repeat, all of their `short` bytes do, so only texts
    with a run of `window` bytes of short repeats, mostly few, are looked at
    for the longer ones; the matches of these are among them too.
    """
    gram, packed = min(gram, short), packed_texts(docs)
    brief = repeated_windows(packed, keyed(docs), short, gram)
    marked = table(packed.join(R.gathered(brief), ["did", "tk"], "left").select("did", "tk", "n_bytes", "z", "starts", "counts").mapInArrow(_mark(short), MARKED), "marked")
    drop(brief)
    some = marked.where(F.col("longest") >= window).select("did", "tk", "n_bytes", "z")
    hits = R.gathered(repeated_windows(some, None, window, gram))
    long = marked.where(F.col("longest") >= window).join(hits, ["did", "tk"], "left")
    rest = marked.where(F.col("longest") < window).withColumns({"starts": F.lit(None).cast("array<long>"), "counts": F.lit(None).cast("array<int>")})
    columns = ["did", "n_bytes", "z", "n_repeated", "starts", "counts"]
    out = long.select(*columns).unionByName(rest.select(*columns)).mapInArrow(_cut(window), CUT)
    return out.select(doc_id("did").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")
