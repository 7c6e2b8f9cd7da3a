"""Exact removal of repeated word windows by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to the
bucket of that minimiser, where sorting their windows counts them exactly.
Packed strings travel only where they can matter: equal ones are first told
apart from the rest by their hashes, and one of each stands for all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .common import as_bytes, doc_id, drop, keyed, packed_texts, sent_if_small, table, unpack

WINDOW, GRAM = 20, 4


def blocks(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first window, count of windows of each super-k-mer of a document with at least `window` words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = len(words) - gram + 1
    g = h[:m].copy()
    for i in range(1, gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : m + i]
    g = R.mixed(g)
    at = sliding_window_view(g, window - gram + 1).argmin(1) + np.arange(len(words) - window + 1)
    first, count = R.run_starts(at)
    return g[at[first]], first, count


def word_ends(words: list[bytes]) -> np.ndarray:
    """Where each word ends in the words joined by single spaces."""
    return np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1


def _describe(window: int, gram: int):
    def run(batches):
        for b in R.sliced(batches):
            out: list = [[], [], [], [], []]
            for did, tk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))):
                words = text.split()
                if len(words) < window:
                    continue
                anchor, first, count = blocks(words, window, gram)
                joined, ends = b" ".join(words), word_ends(words)
                lo = np.append(0, ends + 1)[first].tolist()
                hi = ends[first + count + window - 2].tolist()
                same = np.fromiter([xxhash.xxh3_64_intdigest(joined[a:z]) for a, z in zip(lo, hi)], np.uint64, len(first))
                for x, y in zip(out, (anchor, same, np.full(len(first), did, np.int64), np.full(len(first), tk, np.int64), R.packed_loc(first, count))):
                    x.append(y)
            yield R.meta_batch(*out)

    return run


PACKED = "anchor long, did long, tk long, loc long, packed binary, hot boolean"


def _pack(window: int):
    """Packed strings of the blocks that a document was asked for; those with a hot anchor window by window."""

    def run(batches):
        for b in R.sliced(batches):
            out: list = [[] for _ in range(6)]
            for did, tk, n, z, asked in zip(*(c.to_pylist() for c in b.columns)):
                words = unpack(z, n).split()
                for x in asked:
                    at, count = (int(v[0]) for v in R.unpacked_loc(np.array([x["loc"]])))
                    step = 1 if x["hot"] else count
                    for s in range(at, at + count, step):
                        row = (x["anchor"], did, tk, int(R.packed_loc(np.array([s]), np.array([step]))[0]), b" ".join(words[s : s + step + window - 1]), x["hot"])
                        for o, v in zip(out, row):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()))], names=["anchor", "did", "tk", "loc", "packed", "hot"])

    return run


def _count(window: int):
    """Over rows sorted by anchor: sorts the windows of each bucket; those that also start earlier."""

    def run(batches):
        for t in R.whole_groups(batches, 0, 2048):
            anchor, did, tk, loc = (t.column(i).to_numpy() for i in range(4))
            packed = t.column(4).to_pylist()
            at, count = R.unpacked_loc(loc)
            edge = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
            out: list = [[], [], [], []]
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if hi - lo < 2:
                    continue
                windows = []
                for i in range(lo, hi):
                    w = packed[i].split()
                    windows += [(b" ".join(w[j : j + window]), did[i], at[i] + j, i, j) for j in range(count[i])]
                windows.sort()
                hit = {}
                first = windows[0]
                for w in windows[1:]:
                    if w[0] != first[0]:
                        first = w
                    elif w[1:3] != first[1:3]:
                        hit.setdefault(w[3], np.zeros(count[w[3]], bool))[w[4]] = True
                for i, mask in hit.items():
                    for s, n in R.mask_runs(mask):
                        for o, v in zip(out, (did[i], tk[i], at[i] + s, n)):
                            o.append(v)
            yield R.hit_batch(*out)

    return run


def later_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """did, tk, at, n: runs of windows whose words also start earlier (smaller id, or same id and earlier)."""
    shared = R.shared_blocks(keyed(docs).mapInArrow(_describe(window, gram), R.META))
    kinds = R.classes(shared)
    copied = kinds.where("n > 1").select("anchor", "same", "n", F.col("did").alias("did0"), F.col("at").alias("at0"))
    copies = R.with_class(shared, copied, "did0", "at0").select("did", "tk", F.expr(R.AT), F.expr(R.COUNT), "did0", "at0").where("did > did0 OR (did = did0 AND at > at0)").select("did", "tk", "at", "n")
    packed = table(packed_texts(docs).join(R.rivals(kinds, R.HOT), ["did", "tk"]).select("did", "tk", "n_bytes", "z", "blocks").mapInArrow(_pack(window), PACKED), "packed")
    cold = packed.where("NOT hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_count(window), R.HITS)
    hot = packed.where("hot").select("packed", "did", "tk", F.expr(R.AT))
    first = table(hot.groupBy("packed").agg(F.min(F.struct("did", "at")).alias("x"), F.count("*").alias("k")).where("k > 1").select("packed", F.col("x.did").alias("did0"), F.col("x.at").alias("at0")), "windows")
    late = hot.join(sent_if_small(first), "packed").where("did > did0 OR (did = did0 AND at > at0)").select("did", "tk", "at", F.lit(1).alias("n"))
    hits = table(copies.unionByName(cold).unionByName(late), "hits")
    drop(shared, kinds, packed, first)
    return hits


def _cut(window: int):
    def run(batches):
        for b in R.sliced(batches):
            did, n_bytes, z, starts, counts = (c.to_pylist() for c in b.columns)
            words_in, gone, digest = [], [], []
            for n, packed, s, c in zip(n_bytes, z, starts, counts):
                words = unpack(packed, n).split()
                out = R.covered(np.array(s, np.int64), np.array(c, np.int64), window, len(words)) if s else np.zeros(len(words), bool)
                kept = words if not out.any() else [w for w, x in zip(words, out.tolist()) if not x]
                words_in.append(len(words))
                gone.append(int(out.sum()))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(did, pa.int64()), pa.array(words_in, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["did", "n_words", "n_removed", "kept_sha256"])

    return run


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs.

    A word goes if a window of `window` words that covers it also starts
    earlier: in a row with a smaller id, or earlier in the same row. Null ids
    come before all others; rows that share an id are neither earlier nor later
    than one another where their windows start at the same word. Texts that are
    null, empty or shorter than a window lose nothing; no rows give no rows.
    """
    hits = R.gathered(later_windows(docs, window, gram))
    joined = packed_texts(docs).join(hits, ["did", "tk"], "left").select("did", "n_bytes", "z", "starts", "counts")
    out = joined.mapInArrow(_cut(window), "did long, n_words long, n_removed long, kept_sha256 string")
    return out.select(doc_id("did").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
