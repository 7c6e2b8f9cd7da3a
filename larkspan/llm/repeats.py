"""What the exact repeat removers share: blocks of windows named by a minimiser, and the tables that find repeated ones.

Every window of a document (so many consecutive words or bytes) holds grams;
the one with the smallest hash, the leftmost of ties, is its minimiser.
Consecutive windows with the same minimiser form a block. Equal windows have
equal minimisers at the same place, so only blocks whose minimiser occurs more
than once can hold repeated windows.

A block is anchor (hash of its minimiser), same (hash of all it holds; equal
where anchor and same are), did and tk (64 bits of the text's hash), which name
its text, and loc: its first window's place and, in the last 16 bits, its count
of windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, sent_if_small, table

META = "anchor long, same long, did long, tk long, loc long"
#: Equal blocks, or by default different ones with one anchor, that a task compares; beyond it the former are joined by their sent classes and windows of the latter are dealt one by one.
HOT = 512


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_starts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    return first, np.diff(np.append(first, len(p)))


def packed_loc(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) << 16 | count.astype(np.int64)


def unpacked_loc(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    loc = np.asarray(loc, np.int64)
    return loc >> 16, loc & 0xFFFF


#: The parts of loc, for F.expr.
AT = "shiftright(loc, 16) AS at"
COUNT = "cast(loc & 65535 AS int) AS n"


def meta_batch(anchor: list, same: list, did: list, tk: list, loc: list) -> pa.RecordBatch:
    cat = lambda x, kind: pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, kind))
    return pa.RecordBatch.from_arrays([cat(anchor, np.int64), cat(same, np.int64), cat(did, np.int64), cat(tk, np.int64), cat(loc, np.int64)], names=["anchor", "same", "did", "tk", "loc"])


def shared_blocks(meta: DataFrame) -> DataFrame:
    """The blocks whose anchor occurs more than once. Texts are read once for it; counts combine before they travel; AQE splits hot anchors of the join."""
    meta = table(meta, "blocks")
    twice = table(meta.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    out = table(meta.join(twice, "anchor"), "shared")
    drop(meta, twice)
    return out


def classes(shared: DataFrame) -> DataFrame:
    """One row for equal blocks: anchor, same, n, and did, at, tk, loc of the first of them."""
    first = F.min(F.struct("did", F.expr(AT), "tk", "loc")).alias("first")
    return table(shared.groupBy("anchor", "same").agg(F.count("*").alias("n"), first).select("anchor", "same", "n", "first.did", "first.at", "first.tk", "first.loc"), "classes")


def with_class(shared: DataFrame, copied: DataFrame, *carried: str) -> DataFrame:
    """The blocks whose class is in copied (anchor, same, n, ...), with the carried columns of the class.

    Classes with over HOT blocks come first, sent to every task where they are
    few, so that thousands of equal blocks need not meet in one; the other
    blocks are joined by shuffle.
    """
    keys = ["anchor", "same"]
    hot = sent_if_small(copied.where(F.col("n") > HOT).select(*keys, *carried, F.lit(True).alias("_hot")))
    tagged = shared.join(hot, keys, "left")
    rest = tagged.where("_hot IS NULL").select(*shared.columns).join(copied.where(F.col("n") <= HOT).select(*keys, *carried), keys)
    return tagged.where("_hot").drop("_hot").unionByName(rest)


def rivals(kinds: DataFrame, most: int) -> DataFrame:
    """did, tk and its blocks (anchor, loc, hot) whose anchor has blocks that differ, hot if over `most` do: first of their class each."""
    many = table(kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1"), "rivals")
    found = kinds.join(many, "anchor").select("did", "tk", F.struct("anchor", "loc", (F.col("k") > most).alias("hot")).alias("block"))
    return found.groupBy("did", "tk").agg(F.collect_list("block").alias("blocks"))


#: Texts that a Python worker holds unpacked, with what is made of them.
AT_ONCE = 1000


def sliced(batches):
    """The batches in pieces of at most AT_ONCE rows."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def mask_runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of True."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return [(int(a), int(b - a)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def covered(starts: np.ndarray, counts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n places are inside a window that starts at starts[i] + 0..counts[i]-1."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + counts - 1 + window, n), -1)
    return np.cumsum(step)[:n] > 0


HITS = "did long, tk long, at long, n int"


def hit_batch(did: list, tk: list, at: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(did, pa.int64()), pa.array(tk, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int32())], names=["did", "tk", "at", "n"])


def gathered(hits: DataFrame) -> DataFrame:
    """did, tk, starts, counts: a document's hits, no more than it has windows."""
    return hits.groupBy("did", "tk").agg(F.collect_list(F.struct("at", "n")).alias("x")).select("did", "tk", F.col("x.at").alias("starts"), F.col("x.n").alias("counts"))


def whole_groups(batches, key: int, least: int):
    """Joins batches that are sorted by a column into tables of at least so many rows which split no group."""
    kept: list = []
    rows = 0
    for b in batches:
        if b.num_rows:
            kept.append(b)
            rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(kept)
        column = t.column(key).combine_chunks()
        last, cut = column[-1], len(column) - 1
        while cut and column[cut - 1] == last:
            cut -= 1
        if cut:
            yield t.slice(0, cut)
        kept = t.slice(cut).combine_chunks().to_batches()
        rows = len(column) - cut
    if kept:
        yield pa.Table.from_batches(kept)
