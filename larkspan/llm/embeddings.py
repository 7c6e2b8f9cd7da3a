"""Embedding near-duplicates by binary codes of random rotations, with exact recomputation where they cannot decide.

A unit vector o is rotated; its code is the signs of the rotated coordinates,
and f = <code / sqrt(D), rotated o> is stored with it. For a rotated unit vector
q, <code / sqrt(D), q> / f estimates <o, q> without bias; its error is
sqrt(1 - <o, q>^2) * sqrt(1 - f^2) / f times one coordinate of a random unit
vector of D - 1 dimensions. The rotated vector itself is stored in bytes, which
adds a bounded error. Codes travel, vectors only where a pair's upper bound
reaches the threshold; such pairs are computed in double precision.

Signs of further rotations are the index of a large label: vectors meet where
all bits of one of its tables agree. Two vectors at the threshold agree in a bit
with odds p, so L tables of k bits miss them with odds (1 - p^k)^L, at most
MISSED; k is the number of bits that costs least for the label's size, 0 while
comparing all codes costs less.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, doc_id, doc_key, drop, sent_if_small, table

#: Codes on a side of the square of pairs that a task compares.
BLOCK = 8192
#: Rows of a square that are estimated at once.
STRIP = 256
#: Width of the confidence bound in standard deviations; beyond 6 lies one pair in 10^9.
SIGMAS = 6.0
#: Odds at which the index may miss a pair at the threshold; closer pairs are missed less.
MISSED = 1e-6
#: Seconds for a pair of codes, and for a code in a table of the index.
PAIR_COST, ROW_COST = 1.25e-8, 2e-5


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([11, seed]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def tables(bits: int, threshold: float) -> int:
    """Tables of so many bits that miss a pair at the threshold with odds of at most MISSED."""
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if agree >= 1 else math.ceil(math.log(MISSED) / math.log1p(-agree))


def cheapest_bits(n: float, threshold: float) -> int:
    cost = lambda k: tables(k, threshold) * (n * n / 2 ** (k + 1) * PAIR_COST + n * ROW_COST)
    return min(range(41), key=cost)


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The code (bits), correction factor, rotated vector in bytes, and value of a byte's step, of each unit vector."""
    turned = unit @ rotation(unit.shape[1])
    bits = turned >= 0
    f = np.abs(turned).sum(1) / np.sqrt(unit.shape[1])
    step = np.abs(turned).max(1) / 127
    return np.packbits(bits, axis=1), f.astype(np.float32), np.rint(turned / step[:, None]).astype(np.int8), step.astype(np.float32)


def index_keys(unit: np.ndarray, bits: int, count: int) -> np.ndarray:
    """[i, t]: the bits of vector i in table t."""
    dim = unit.shape[1]
    if not bits:
        return np.zeros((len(unit), count), np.int64)
    signs = np.concatenate([unit @ rotation(dim, 1 + r) >= 0 for r in range(-(-bits * count // dim))], axis=1)[:, : bits * count]
    return (signs.reshape(len(unit), count, bits).astype(np.int64) << np.arange(bits)).sum(2)


def estimated_pairs(a: tuple, b: tuple, threshold: float, same: bool):
    """Strips (i, j) of pairs whose upper bound reaches the threshold. a, b: code, f, bytes, step of each side; of one side with itself, i < j."""
    dim = a[2].shape[1]
    turned = a[2].astype(np.float32) * a[3][:, None]
    code = ((np.unpackbits(b[0], axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))).T
    f = b[1].astype(np.float64)
    width = np.sqrt(np.maximum(1 - f * f, 0)) / f / np.sqrt(max(dim - 1, 1))
    # a pair at the threshold or above deviates by no more than this, but for the bytes' rounding
    least = (f * (threshold - SIGMAS * np.sqrt(max(0.0, 1 - threshold**2)) * width) - 1e-5).astype(np.float32)
    for s in range(0, len(turned), STRIP):
        rounding = a[3][s : s + STRIP, None] * np.float32(np.sqrt(dim) / 2)
        near = turned[s : s + STRIP] @ code + rounding >= least
        i, j = np.nonzero(np.triu(near, s + 1) if same else near)
        if len(i):
            yield i + s, j


def exact(va: np.ndarray, vb: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a cosine, in double precision, of at least the threshold."""
    x, y = va[i], vb[j]
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)) >= threshold


def forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what the given pairs connect."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


CODES = "head long, label string, d int, n long, code binary, f float, q binary, step float, keys array<long>, v array<double>"


def _encode(batches):
    """Codes of vectors; within a batch, those of a length and a label's size together."""
    for b in batches:
        shape = np.stack([b.column(k).to_numpy() for k in (2, 5, 6)], axis=1).astype(np.int64)
        out: list = [[None] * b.num_rows for _ in range(5)]
        vectors = b.column(4)
        for kind in np.unique(shape, axis=0):
            dim, bits, count = kind.tolist()
            rows = np.flatnonzero((shape == kind).all(1))
            unit = units(np.asarray(vectors.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), dim))
            code, f, q, step = encode(unit)
            keys = index_keys(unit, bits, count)
            for x, values in zip(out, ([c.tobytes() for c in code], f.tolist(), [c.tobytes() for c in q], step.tolist(), keys.tolist())):
                for r, v in zip(rows.tolist(), values):
                    x[r] = v
        kinds = (pa.binary(), pa.float32(), pa.binary(), pa.float32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), *(pa.array(x, k) for x, k in zip(out, kinds)), vectors], names=[c.split()[0] for c in CODES.split(", ")])


def _side(t: pa.Table, dim: int) -> tuple:
    rows = lambda name, kind: np.frombuffer(b"".join(t[name].to_pylist()), kind).reshape(len(t), -1)
    return rows("code", np.uint8), t["f"].to_numpy(), rows("q", np.int8).reshape(len(t), dim), t["step"].to_numpy()


def _sides(key, t: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    left, right = t.filter(pc.equal(t["side"], 0)), t.filter(pc.equal(t["side"], 1))
    same = key[-2].as_py() == key[-1].as_py()
    return left, left if same else right, same


SQUARE = ["label", "d", "table", "key", "low", "high"]
ASKED = "label string, d int, table int, key long, low int, high int, side int, head long"


def _estimate(threshold: float):
    """The vectors of a square whose pairs the codes cannot rule out."""

    def run(key, t):
        left, right, same = _sides(key, t)
        wanted = [np.zeros(len(left), bool), np.zeros(len(right), bool)]
        if len(left) and len(right):
            a = _side(left, key[1].as_py())
            for i, j in estimated_pairs(a, a if same else _side(right, key[1].as_py()), threshold, same):
                wanted[0][i] = True
                wanted[1][j] = True
        if same:
            wanted = [wanted[0] | wanted[1]]
        heads = [x["head"].to_numpy()[w] for x, w in zip((left, right), wanted)]
        n = sum(map(len, heads))
        names = [c.split()[0] for c in ASKED.split(", ")]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        columns = [pa.array([k.as_py()] * n, kind) for k, kind in zip(key, kinds)]
        return pa.table([*columns, pa.array(np.repeat(np.arange(len(heads)), [len(h) for h in heads]), pa.int32()), pa.array(np.concatenate(heads), pa.int64())], names=names)

    return run


LINKS = "kind int, head long, other long, n long"


def _compare(threshold: float):
    """Links of a square, each in the first table that has it: sums for each vector (kind 0) and what connects them (kind 1)."""

    def run(key, t):
        left, right, same = _sides(key, t)
        dim, at = key[1].as_py(), key[2].as_py()
        cols: tuple = ((), (), (), ())
        if len(left) and len(right):
            both = [left] if same else [left, right]
            heads = [x["head"].to_numpy() for x in both]
            n = [x["n"].to_numpy() for x in both]
            v = [np.asarray(x["v"].combine_chunks().flatten(), np.float64).reshape(-1, dim) for x in both]
            keys = [np.asarray(x["keys"].combine_chunks().flatten(), np.int64).reshape(len(x), -1)[:, :at] for x in both]
            sides = [_side(x, dim) for x in both]
            sums, edges = [np.zeros(len(x)) for x in heads], []
            up = len(heads[0]) if not same else 0
            for i, j in estimated_pairs(sides[0], sides[-1], threshold, same):
                for s in range(0, len(i), 1 << 16):
                    p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    first = ~(keys[0][p] == keys[-1][q]).any(1)
                    p, q = p[first], q[first]
                    near = exact(v[0], v[-1], p, q, threshold)
                    p, q = p[near], q[near]
                    sums[0] += np.bincount(p, n[-1][q], len(sums[0]))
                    sums[-1] += np.bincount(q, n[0][p], len(sums[-1]))
                    edges += forest(p, q + up)
            e = np.array(edges, np.int64).reshape(-1, 2)
            e = np.array(forest(e[:, 0], e[:, 1]), np.int64).reshape(-1, 2)
            heads, sums = np.concatenate(heads), np.concatenate(sums)
            linked = np.flatnonzero(sums > 0)
            cols = (np.append(np.zeros(len(linked)), np.ones(len(e))), np.append(heads[linked], heads[e[:, 0]]), np.append(np.zeros(len(linked), np.int64), heads[e[:, 1]]), np.append(sums[linked], np.zeros(len(e))))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(np.asarray(c, np.int64), pa.int64()).cast(k) for c, k in zip(cols, kinds)], names=["kind", "head", "other", "n"])

    return run


def links(heads: DataFrame, threshold: float) -> DataFrame:
    """kind, head, other, n (see _compare) of different vectors. heads: head, label, v, n."""
    heads = heads.select("head", F.col("label").cast("string").alias("label"), F.size("v").alias("d"), "n", "v")
    best = [cheapest_bits(2.0**i, threshold) for i in range(51)]
    size = F.floor(F.log2(F.count("*"))).cast("int")
    plan = heads.groupBy("label", "d").agg(F.get(F.array(*map(F.lit, best)), size).alias("bits"), F.get(F.array(*[F.lit(tables(k, threshold)) for k in best]), size).alias("tables"))
    planned = heads.join(sent_if_small(table(plan, "plan")), ["label", "d"])
    codes = table(planned.select("head", "label", "d", "n", "v", "bits", "tables").mapInArrow(_encode, CODES), "codes")
    rows = codes.select("label", "d", "head", "n", "code", "f", "q", "step", F.posexplode("keys").alias("table", "key"))
    bucket = SQUARE[:4]
    full = table(rows.groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).drop("m"), "buckets")
    dealt = rows.join(sent_if_small(full), bucket).withColumn("i", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int"))
    # block i meets blocks j >= i; side 0 is the lower one
    pairs = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(*bucket, F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), (F.col("i") > F.col("j")).cast("int").alias("side"), "head", "code", "f", "q", "step")
    asked = table(pairs.groupBy(*SQUARE).applyInArrow(_estimate(threshold), ASKED), "asked")
    vectors = asked.join(codes.drop("label", "d"), "head")
    found = table(vectors.groupBy(*SQUARE).applyInArrow(_compare(threshold), LINKS), "links")
    drop(codes, full, asked)
    return found


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Vectors link with others of the same label, not null, and the same length at
    a cosine of at least `threshold`. Vectors that are null, empty, zero or hold
    null, NaN or infinite components link with nothing, nor do those whose label
    is null. Equal vectors of a label are compared once and carry their number.
    A null id counts as smaller than any other; no rows give no rows.

    A bucket of the index (a whole label, where that is small) is dealt by hash
    into blocks; each pair of blocks is a task of bounded size, so a label with
    a third of all rows makes more tasks, not larger ones. A pair that meets in
    several tables counts in the first.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size(v) > 0)
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are one value
    plain = F.transform(v, lambda x: x + F.lit(0.0))
    rows = table(vectors.select(doc_key("vec_id").alias("vid"), F.when(fine, F.col("label")).alias("label"), F.when(fine, plain).alias("v")), "vectors")
    good = rows.where("label IS NOT NULL")
    # a different vector of a label is a node with a number of its own, whatever its ids
    heads = table(good.groupBy("label", "v").agg(F.min("vid").alias("least"), F.count("*").alias("n")).withColumn("head", F.monotonically_increasing_id()), "heads")
    found = links(heads, threshold)
    counts = found.where("kind = 0").groupBy("head").agg(F.sum("n").alias("links"))
    ends = table(connected_components(found.where("kind = 1"), "head", "other").select(F.col("node").alias("head"), "root"), "ends")
    least = table(ends.join(heads.select("head", "least"), "head").groupBy("root").agg(F.min("least").alias("first")), "firsts")
    roots = ends.join(sent_if_small(least), "root").select("head", "first")
    named = table(heads.join(counts, "head", "left").join(roots, "head", "left").select("label", "v", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", "least").alias("root")), "classes")
    out = rows.join(named, ["label", "v"], "left")
    others = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.col("links") + F.col("n") - 1).cast("long")
    root = F.coalesce("root", "vid")
    return out.select(doc_id("vid").alias("vec_id"), others.alias("n_links"), doc_id(root).alias("component_id"), (F.col("vid") == root).alias("kept"))

