"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint carries a vector m(i) of radius + 1 bits; table v, for
each v other than 0, keeps the bits with odd <m(i), v>. Any `radius` vectors
leave some v orthogonal to all of them, so two fingerprints that differ in at
most `radius` bits agree in some table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import as_bytes, connected_components, doc_id, doc_key, group_bounds, table
from .repeats import mixed

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Fingerprints that one task compares with each other; a larger bucket is dealt again by masks over its free bits.
BUCKET = 2048
#: Each dealing halves the free bits, so the third leaves 8 of 64, or 256 different fingerprints, at radius 3.
LEVELS = 3
ROW = "kind int, fixed long, value long, fp long, head long, other long"


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `words` lower-cased words, joined by spaces; of all words if there are fewer."""
    w = text.translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    length = np.fromiter(map(len, w), np.int64, len(w)) + 1
    ends = np.cumsum(length)
    starts = (ends - length)[: len(w) - words + 1].tolist()
    ends = (ends - 1)[words - 1 :].tolist()
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, ends)], np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit j is set if it is set in over half the hashes; none: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum()) if len(hashes) else 0


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """did, fp (as a signed long) of every row; a null text is an empty one."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(t or b"", words)) for t in as_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["did", "fp"])

    return spread(docs.select(doc_key().alias("did"), "text")).mapInArrow(run, "did long, fp long")


def covering_masks(radius: int, free: int = 2**64 - 1) -> list[int]:
    """The 2^(radius+1) - 1 masks over the bits that are set in free."""
    bits = [i for i in range(64) if free >> i & 1]
    if len(bits) >= 2 ** (radius + 1):  # all vectors, alike often: each mask has half of the bits
        vectors = [j % 2 ** (radius + 1) for j in range(len(bits))]
    else:  # the unit vectors leave no mask empty; the others are spread by a fixed hash
        noise = mixed(np.arange(1, len(bits) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        vectors = [1 << j if j <= radius else int(noise[j]) % 2 ** (radius + 1) for j in range(len(bits))]
    masks = [sum(1 << b for b, m in zip(bits, vectors) if (m & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]
    return list(dict.fromkeys(masks))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def tree_links(fp: np.ndarray, head: np.ndarray, radius: int) -> tuple[list, list]:
    """Links (of at most `radius` bits) that connect what all such links among these fingerprints connect."""
    rest = np.argsort(head, kind="stable")
    a, b = [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[x]) <= radius
            if near.any():
                new, rest = rest[near], rest[~near]
                a += [head[x]] * len(new)
                b += head[new].tolist()
                queue += new.tolist()
    return a, b


def _compare(radius: int, last: bool):
    """Over rows sorted by (fixed, value): links within each bucket; the rows of an overfull bucket, dealt by further masks."""

    def deal(fixed, fp, head):
        free = ~int(fixed) & (2**64 - 1)
        out = []
        for m in covering_masks(radius, free):
            now = np.uint64(int(fixed) | m)
            out.append((np.full(len(fp), now), fp & now, fp, head))
        return [np.concatenate(x) for x in zip(*out)]

    def run(batches):
        def emit(kind, fixed, value, fp, head, other):
            n = len(head)
            z = np.zeros(n, np.int64)
            cols = [np.full(n, kind, np.int32), *[z if x is None else np.asarray(x).view(np.int64) if getattr(x, "dtype", None) == np.uint64 else np.asarray(x, np.int64) for x in (fixed, value, fp, head, other)]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in ROW.split(", ")])

        carry, over = None, None
        for b in _with_end(batches):
            if b is None:
                rows, carry = carry, None
                if rows is None:
                    break
            else:
                rows = [b.column(i).to_numpy().view(np.uint64) for i in (0, 1, 2)] + [b.column(3).to_numpy()]
                if carry is not None:
                    rows = [np.concatenate(x) for x in zip(carry, rows)]
                    carry = None
            if not len(rows[0]):
                continue
            edge = group_bounds(rows[0], rows[1])
            if b is not None:  # the last bucket may go on in the next batch
                cut = edge[-2]
                carry, rows, edge = [x[cut:] for x in rows], [x[:cut] for x in rows], edge[:-1]
            fixed, value, fp, head = rows
            a, c = [], []
            busy = np.diff(edge) > 1
            if len(busy) and over == (fixed[0], value[0]):
                busy[0] = True
            for s in np.flatnonzero(busy):
                lo, hi = edge[s], edge[s + 1]
                key = (fixed[lo], value[lo])
                if not last and (hi - lo > BUCKET or over == key):
                    yield emit(1, *deal(fixed[lo], fp[lo:hi], head[lo:hi]), None)
                else:
                    x, y = tree_links(fp[lo:hi], head[lo:hi], radius)
                    a += x
                    c += y
            if a:
                yield emit(0, None, None, None, a, c)
            if carry is not None and not last and (len(carry[0]) > BUCKET or (over is not None and len(carry[0]) and over == (carry[0][0], carry[1][0]))):
                over = (carry[0][0], carry[1][0])
                yield emit(1, *deal(carry[0][0], carry[2], carry[3]), None)
                carry = None

    return run


def _with_end(batches):
    yield from batches
    yield None


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """head, other: links of at most `radius` bits which connect all that such links connect. nodes: fp, head.

    Buckets travel by (mask, kept bits); a task streams over its sorted buckets
    and holds one of at most BUCKET rows. Larger ones come back as rows for the
    next level, dealt by masks over the bits that are still free.
    """
    masks = [_signed(m) for m in covering_masks(radius)]
    rows = nodes.select(F.explode(F.array(*[F.struct(F.lit(m).alias("fixed"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for m in masks])).alias("x"), "fp", "head").select("x.fixed", "x.value", "fp", "head")
    found = []
    for level in range(LEVELS):
        dealt = rows.repartition("fixed", "value").sortWithinPartitions("fixed", "value", "head")
        out = table(dealt.mapInArrow(_compare(radius, level == LEVELS - 1), ROW), "links")
        found.append(out.where("kind = 0").select("head", "other"))
        rows = out.where("kind = 1").select("fixed", "value", "fp", "head")
        if rows.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def components(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs.

    Equal fingerprints meet first and go on as one node named by their smallest
    id, so copies cost one row. Texts without words (null ones too) have
    fingerprint zero and are linked like any other. A null id counts as
    smaller than any other; rows with the same id are linked by it where they
    share a fingerprint only. No rows give no rows.
    """
    prints = table(fingerprints(docs, words), "fingerprints")
    heads = prints.groupBy("fp").agg(F.min("did").alias("head"))
    roots = connected_components(links(heads, radius), "head", "other").select(F.col("node").alias("head"), "root")
    named = heads.join(roots, "head", "left").select("fp", F.coalesce("root", "head").alias("root"))
    return prints.join(named, "fp").select(doc_id("did").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), doc_id("root").alias("component_id"))
