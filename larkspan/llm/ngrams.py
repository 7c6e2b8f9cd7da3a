"""Stupid-backoff scores of documents under the n-grams of the whole corpus, computed relationally.

Documents are read in batches. A batch explodes into its different n-grams of
each order, packed as sorted 64-bit hashes by the bucket of their leading bits;
a bucket gathers one row per batch, adds up the count table of its n-grams, and
answers each batch with the counts of what it asked. So a word pair in every
document costs one entry per batch, and what travels grows with the input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import as_bytes, doc_id, doc_key, table

ALPHA = 0.4
#: The longest n-grams, and how often those of two words or more must occur to be in the model: once, all are.
ORDER, CUTOFF = 3, 1
#: Bytes of text of a batch, at least, but for the last of a partition.
BATCH = 8 << 20
#: N-grams of a bucket, about; buckets follow the corpus.
BUCKET = 1_500_000
BATCHES = "batch long, dids binary, bytes array<int>, n_words long, n_bytes long, z binary"


def _batch(batches):
    """Documents, packed into batches; the batch's number has the partition in its high bits."""
    codec, part, seq = pa.Codec("zstd", compression_level=1), TaskContext.get().partitionId(), 0
    dids, texts, size = [], [], 0

    def full():
        joined = b"".join(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | seq], pa.int64()), pa.array([np.array(dids, "<i8").tobytes()], pa.binary()), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([sum(len(t.split()) for t in texts)], pa.int64()), pa.array([len(joined)], pa.int64()), pa.array([codec.compress(joined, asbytes=True) if joined else b""], pa.binary())],
            names=["batch", "dids", "bytes", "n_words", "n_bytes", "z"],
        )

    for b in batches:
        for did, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
            dids.append(did)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= BATCH:
                yield full()
                dids, texts, size, seq = [], [], 0, seq + 1
    if dids:
        yield full()


def grams(sizes: list[int], n_bytes: int, z: bytes, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a batch: words of each document, and for n = 1 to order the hash of the n words that end at each word (0 where the document has fewer)."""
    data = pa.Codec("zstd").decompress(z, decompressed_size=n_bytes, asbytes=True) if n_bytes else b""
    hashes, n, at = [], [], 0
    for size in sizes:
        w = data[at : at + size].split()
        at += size
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)))
        n.append(len(w))
    count = np.array(n, np.int64)
    out = [np.maximum(np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.uint64(1))]
    place = np.arange(len(out[0])) - np.repeat(np.cumsum(count) - count, count)
    for k in range(1, order):
        x = np.zeros(len(out[0]), np.uint64)
        x[1:] = out[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + out[0][1:] * np.uint64(3)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(np.where(place >= k, np.maximum(x ^ (x >> np.uint64(32)), np.uint64(1)), np.uint64(0)))
    return count, out


def pack(h: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted hashes as their differences in 8 planes of bytes, then the counts; planes compress where bytes alike meet."""
    step = np.diff(h, prepend=np.uint64(0))
    raw = step.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(n: int, z: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(z, decompressed_size=12 * n, asbytes=True), np.uint8)
    step = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(step, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


ASKED = "kind int, bucket int, batch long, n long, z binary"


def _ask(buckets: int, orders: tuple[int, ...]):
    """One row for each batch, order of n-gram (of the given ones) and bucket that has any."""

    def run(batches):
        edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
        for b in batches:
            for batch, sizes, n_bytes, z in zip(*(c.to_pylist() for c in b.columns)):
                hashes = grams(sizes, n_bytes, z, max(orders))[1]
                for kind in orders:
                    h = hashes[kind - 1]
                    h, times = np.unique(h[h > 0], return_counts=True)
                    cut = np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))  # equal ranges of hashes
                    rows = [(k, cut[k], cut[k + 1]) for k in np.flatnonzero(np.diff(cut)).tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(rows), pa.int32()), pa.array([k for k, _, _ in rows], pa.int32()), pa.array([batch] * len(rows), pa.int64()), pa.array([int(y - x) for _, x, y in rows], pa.int64()), pa.array([pack(h[x:y], times[x:y]) for _, x, y in rows], pa.binary())],
                        names=["kind", "bucket", "batch", "n", "z"],
                    )

    return run


ANSWERS = "batch long, kind int, bucket int, n long, z binary"


def _answer(key, t):
    """The counts, over all batches, of what each batch asked of one bucket; in the order in which it asked."""
    asked = [unpack(n, z) for n, z in zip(t["n"].to_pylist(), t["z"].to_pylist())]
    h, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    total = np.bincount(at, np.concatenate([a[1] for a in asked]), len(h)).astype(np.int64)
    codec, end, out = pa.Codec("zstd", compression_level=1), 0, []
    for a, _ in asked:
        mine = total[at[end : end + len(a)]]
        end += len(a)
        out.append(codec.compress(mine.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True))
    return pa.table([t["batch"], t["kind"], t["bucket"], t["n"], pa.array(out, pa.binary())], names=["batch", "kind", "bucket", "n", "z"])


def _counts(h: np.ndarray, answers: list) -> np.ndarray:
    """The corpus's count of each n-gram of a batch; 0 where the hash is 0."""
    parts = [np.ascontiguousarray(np.frombuffer(pa.Codec("zstd").decompress(a["z"], decompressed_size=8 * a["n"], asbytes=True), np.uint8).reshape(8, a["n"]).T).view("<u8").ravel() for a in sorted(answers, key=lambda a: a["bucket"])]
    out, there = np.zeros(len(h)), h > 0
    out[there] = np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.float64)[np.unique(h[there], return_inverse=True)[1]]
    return out


def _score(total: int, order: int, cutoff: int):
    def run(batches):
        for b in batches:
            for dids, sizes, n_bytes, z, answers in zip(*(c.to_pylist() for c in b.columns)):
                n, hashes = grams(sizes, n_bytes, z, order)
                c = [_counts(h, [a for a in answers or [] if a["kind"] == k]) for k, h in enumerate(hashes, 1)]
                s = np.log(c[0] / max(total, 1))
                longest, used = np.ones(len(s), np.int64), np.ones(len(s), np.int64)
                once = c[0] == 1
                for k in range(1, order):
                    there, in_model = np.flatnonzero(hashes[k]), np.flatnonzero((hashes[k] > 0) & (c[k] >= cutoff))
                    longest[there] = k + 1
                    once[there] = c[k][there] == 1
                    s[there] += math.log(ALPHA)
                    used[in_model] = k + 1
                    s[in_model] = np.log(c[k][in_model] / c[k - 1][in_model - 1])
                owner = np.repeat(np.arange(len(n)), n)
                score = pa.array(np.bincount(owner, s, len(n)), mask=n == 0)
                of = lambda mask: pa.array(np.bincount(owner[mask], minlength=len(n)))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(dids, "<i8")), pa.array(n), of(used < longest), of(once), score], names=["did", "n_words", "backed_off", "seen_once", "log_score"])

    return run


def score(docs: DataFrame, order: int = ORDER, cutoff: int = CUTOFF) -> DataFrame:
    """doc_id, n_words, backed_off, seen_once, log_score of every row of docs, under a model of all of them.

    A word that follows others is scored by the longest n-gram of at most
    `order` words that ends at it and occurs at least `cutoff` times (a single
    word always counts): ln c(n-gram) / c(all but its last word), or
    ln c(w) / N for the word alone, and ln ALPHA more for each longer n-gram
    that the document has there. log_score sums this over the whole text.
    backed_off counts the words scored by less than the longest n-gram there,
    seen_once those whose longest n-gram the corpus has nowhere else. A text
    without words, a null one too, has null. Words are unchanged runs of bytes
    other than white space; n-grams are told apart by 64-bit hashes. Repeated
    rows count as often as they occur; no rows give no rows.
    """
    packed = table(spread(docs.select(doc_key().alias("did"), "text")).mapInArrow(_batch, BATCHES), "batches")
    total = packed.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(16, math.ceil(total / BUCKET))
    answers = None
    # one after the other, so that the n-grams of one pass only are on disk
    for orders in [(1, 2)[:order], *((n,) for n in range(3, order + 1))]:
        asked = packed.select("batch", "bytes", "n_bytes", "z").mapInArrow(_ask(buckets, orders), ASKED)
        some = table(asked.groupBy("kind", "bucket").applyInArrow(_answer, ANSWERS), "answers")
        answers = some if answers is None else answers.unionByName(some)
    gathered = answers.groupBy("batch").agg(F.collect_list(F.struct("kind", "bucket", "n", "z")).alias("answers"))
    joined = packed.join(gathered, "batch", "left").select("dids", "bytes", "n_bytes", "z", "answers")
    out = joined.mapInArrow(_score(total, order, cutoff), "did long, n_words long, backed_off long, seen_once long, log_score double")
    return out.select(doc_id("did").alias("doc_id"), "n_words", "backed_off", "seen_once", "log_score")
