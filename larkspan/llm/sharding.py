"""K-d tree sharding: recursive splits at distributed weighted medians along the widest metadata dimension.

A tree is kept as a heap: node p has the children 2p + 1 and 2p + 2, a
dimension (-1 for a leaf) and a cut; rows below the cut go left. How many
leaves a node has follows from its place alone. The top TOP leaves are split
over all rows, level by level; where more shards are wanted, each top leaf, by
then a small share of all rows, is split further in a task of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import doc_key, drop, sent_if_small, table

#: Sums that a pass sends to the driver, at most, and bins of a node at most and at least.
SUMS, MOST_BINS, LEAST_BINS = 1 << 16, 2048, 16
#: A split is settled once the histogram bin that holds the median weighs less than this share of a leaf.
TOLERANCE = 0.002
#: Leaves that are split over all rows; the subtree of each further one fits a task.
TOP = 4096
DIMS = ("source", "lang", "n_chars", "doc_id")
ROW, COORDS = "__lk_row", "__lk_coords"


def _halves(leaves: int) -> tuple[int, int]:
    return leaves // 2, leaves - leaves // 2


class Tree:
    """Dimension and cut of each node of a heap, its first shard and its number of shards."""

    def __init__(self, shards: int, grain: int = 1):
        self.first, self.leaves = {0: 0}, {0: shards}
        self.dim, self.cut, self.depth = {}, {}, 0
        todo = [(0, 0)]
        while todo:
            p, depth = todo.pop()
            self.depth = max(self.depth, depth)
            if self.leaves[p] > grain:
                left, right = _halves(self.leaves[p])
                self.first |= {2 * p + 1: self.first[p], 2 * p + 2: self.first[p] + left}
                self.leaves |= {2 * p + 1: left, 2 * p + 2: right}
                todo += [(2 * p + 1, depth + 1), (2 * p + 2, depth + 1)]
        self.inner = {p for p in self.leaves if 2 * p + 1 in self.leaves}

    def arrays(self) -> tuple[list[int], list[float], list[int]]:
        """dim, cut and first shard by place in the heap; nodes without a cut yet count as leaves."""
        n = max(self.leaves) + 1
        return [self.dim.get(p, -1) for p in range(n)], [self.cut.get(p, 0.0) for p in range(n)], [self.first.get(p, 0) for p in range(n)]


def _array(values, kind: str) -> F.Column:
    return F.expr("array(" + ",".join(f"{v!r}D" if kind == "double" else str(int(v)) for v in values) + f")").cast(f"array<{kind}>")


def _place(dim: F.Column, cut: F.Column, depth: int) -> F.Column:
    """The place in the heap where a row ends."""

    def step(p, _):
        d = F.get(dim, p)
        return F.when(d < 0, p).otherwise(2 * p + 1 + (F.get(F.col(COORDS), d) >= F.get(cut, p)).cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0), step)


def kd_tree(rows: DataFrame, n_dims: int, shards: int) -> Tree:
    """Grows the tree level by level over rows (size and the coordinates), down to nodes of at most shards / TOP leaves.

    All nodes of a level share each pass: weights by bins of the widest side of
    the node's box, then finer bins inside the one that holds the median.
    """
    tree = Tree(shards, max(1, -(-shards // TOP)))
    whole = rows.agg(F.sum("size"), *[f(F.get(COORDS, F.lit(d))) for d in range(n_dims) for f in (F.min, F.max)]).first()
    if whole[0] is None:  # no rows
        tree.dim, tree.cut = dict.fromkeys(tree.inner, 0), dict.fromkeys(tree.inner, 0.0)
        return tree
    weight, box = {0: whole[0]}, {0: [(whole[2 * d + 1], whole[2 * d + 2]) for d in range(n_dims)]}
    width = [(high - low) or 1.0 for low, high in box[0]]
    level, depth = [0] if 0 in tree.inner else [], 0
    while level:
        search = {}
        dim_of = {p: max(range(n_dims), key=lambda d: (box[p][d][1] - box[p][d][0]) / width[d]) for p in level}
        for p in level:
            low, high = box[p][dim_of[p]]
            # lo, hi: the cut lies in here; below: weight under lo
            search[p] = {"lo": low, "hi": high, "below": 0, "goal": weight[p] * _halves(tree.leaves[p])[0] / tree.leaves[p], "leaf": weight[p] / tree.leaves[p]}
        dim, cut, _ = tree.arrays()
        placed = rows.select("size", COORDS, _place(_array(dim, "int"), _array(cut, "double"), depth).alias("p")) if depth else rows.select("size", COORDS, F.lit(0).alias("p"))
        cuts = {}
        for _ in range(14):
            if not search:
                break
            bins_each = max(LEAST_BINS, min(MOST_BINS, SUMS // len(search)))
            base, n = min(search), max(search) - min(search) + 1
            arrays = [[0] * n, [0.0] * n, [-1.0] * n, [1.0] * n]
            for p, q in search.items():
                for a, v in zip(arrays, (dim_of[p], float(q["lo"]), float(q["hi"]), max((q["hi"] - q["lo"]) / bins_each, 5e-324))):
                    a[p - base] = v
            at = F.col("p") - base
            d, lo, hi, step = (F.get(_array(a, k), at) for a, k in zip(arrays, ("int", "double", "double", "double")))
            cell = placed.where((at >= 0) & (at < n)).select("p", "size", F.get(F.col(COORDS), d).alias("v"), lo.alias("lo"), hi.alias("hi"), step.alias("step")).where("v BETWEEN lo AND hi")
            cell = cell.withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / F.col("step")), F.lit(bins_each - 1)))
            bins: dict = {}
            for r in cell.groupBy("p", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
                bins.setdefault(r["p"], []).append(r)
            for p, q in list(search.items()):
                below, r = q["below"], None
                for r in sorted(bins.get(p, []), key=lambda r: r["bin"]):
                    if below + r["w"] >= q["goal"]:
                        break
                    below += r["w"]
                if r is None:  # a node without rows
                    cuts[p] = (q["lo"], 0)
                    del search[p]
                elif r["lo"] == r["hi"] or r["w"] <= TOLERANCE * q["leaf"] or r["n"] == 1:
                    # the bin goes whole to the side where it leaves the smaller error
                    over = below + r["w"] - q["goal"] < q["goal"] - below
                    cuts[p] = (float(math.nextafter(r["hi"], math.inf)), below + r["w"]) if over else (float(r["lo"]), below)
                    del search[p]
                else:
                    q.update(lo=r["lo"], hi=r["hi"], below=below)
        for p, q in search.items():
            cuts[p] = (float(q["hi"]), q["goal"])
        below_level = []
        for p in level:
            tree.dim[p], (tree.cut[p], left) = dim_of[p], cuts[p]
            low, high = box[p][dim_of[p]]
            for kid, side, w in ((2 * p + 1, (low, tree.cut[p]), left), (2 * p + 2, (tree.cut[p], high), weight[p] - left)):
                weight[kid], box[kid] = w, [side if d == dim_of[p] else b for d, b in enumerate(box[p])]
                if kid in tree.inner:
                    below_level.append(kid)
        level, depth = below_level, depth + 1
    return tree


def split_in_memory(size: np.ndarray, coords: np.ndarray, leaves: int, width: np.ndarray) -> Tree:
    """The same tree over rows that fit a task; coords: one row a dimension."""
    tree = Tree(leaves)
    held = {0: np.arange(len(size))}
    for p in sorted(tree.inner):
        at = held.pop(p)
        side = [float(np.ptp(c[at])) / w if len(at) else 0.0 for c, w in zip(coords, width)]
        d = int(np.argmax(side))
        at = at[np.argsort(coords[d][at], kind="stable")]
        v, upto = coords[d][at], np.append(0, np.cumsum(size[at]))
        edge = np.append(np.flatnonzero(np.append(True, v[1:] != v[:-1])), len(at)) if len(at) else np.zeros(1, np.int64)
        k = int(edge[np.argmin(np.abs(upto[edge] - upto[-1] * _halves(tree.leaves[p])[0] / tree.leaves[p]))])
        tree.dim[p], tree.cut[p] = d, float(v[k]) if k < len(at) else (math.nextafter(float(v[-1]), math.inf) if len(at) else 0.0)
        held[2 * p + 1], held[2 * p + 2] = at[:k], at[k:]
    return tree


def _subtrees(rows: DataFrame, tree: Tree, n_dims: int) -> DataFrame | None:
    """top, dim, cut, first of each top leaf that has more than one shard; None if there is none."""
    many = {p: (tree.first[p], tree.leaves[p]) for p in tree.leaves if p not in tree.inner and tree.leaves[p] > 1}
    if not many:
        return None
    whole = rows.agg(*[F.max(F.get(COORDS, F.lit(d))) - F.min(F.get(COORDS, F.lit(d))) for d in range(n_dims)]).first()
    width = np.array([x or 1.0 for x in whole])

    def build(key, t):
        first, leaves = many[key[0].as_py()]
        coords = np.array(t[COORDS].combine_chunks().flatten(), np.float64).reshape(len(t), n_dims).T
        dim, cut, own = split_in_memory(t["size"].to_numpy().astype(np.float64), coords, leaves, width).arrays()
        return pa.table({"top": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.list_(pa.int32())), "cut": pa.array([cut], pa.list_(pa.float64())), "first": pa.array([[first + x for x in own]], pa.list_(pa.int32()))})

    dim, cut, _ = tree.arrays()
    placed = rows.select("size", COORDS, _place(_array(dim, "int"), _array(cut, "double"), tree.depth).alias("top"))
    return table(placed.where(F.col("top").isin(list(many))).groupBy("top").applyInArrow(build, "top int, dim array<int>, cut array<double>, first array<int>"), "subtrees")


def routed(rows: DataFrame, tree: Tree, subtrees: DataFrame | None, name: str) -> DataFrame:
    """rows, which have the coordinates, with their shard; nothing is shuffled for it."""
    dim, cut, first = tree.arrays()
    top = _place(_array(dim, "int"), _array(cut, "double"), tree.depth)
    if subtrees is None:
        return rows.withColumn(name, F.get(_array(first, "int"), top))
    deepest = math.ceil(math.log2(max(tree.leaves[p] for p in tree.leaves if p not in tree.inner))) + 1
    kept = rows.columns
    known = subtrees.select(F.col("top").alias("__lk_top"), F.col("dim").alias("__lk_dim"), F.col("cut").alias("__lk_cut"), F.col("first").alias("__lk_first"))
    # at most 2 * TOP rows; their arrays hold about 40 bytes a shard
    both = rows.withColumn("__lk_top", top).join(sent_if_small(known), "__lk_top", "left")
    shard = F.when(F.col("__lk_first").isNull(), F.get(_array(first, "int"), F.col("__lk_top"))).otherwise(F.get("__lk_first", _place(F.col("__lk_dim"), F.col("__lk_cut"), deepest)))
    return both.withColumn(name, shard).select(*[F.col(f"`{c}`") for c in kept], name)


def shards_for(rows: DataFrame, shards: int | None, target_bytes: int | None) -> int:
    """The number of shards as given, or as many as bring each to the target bytes."""
    if shards is None:
        total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        shards = max(1, -(-total // target_bytes))
    return shards


def _coordinates(docs: DataFrame, dims: tuple[str, ...], row: F.Column) -> F.Column:
    """A row's coordinates, an array; see shard()."""
    jitter = F.shiftrightunsigned(row, 11).cast("double") / F.lit(float(2**53))
    kinds = dict(docs.dtypes)

    def coordinate(name: str) -> F.Column:
        if name not in kinds:
            return F.lit(0.0)
        number = kinds[name] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[name].startswith("decimal")
        value = F.col(name).cast("double") if number else F.pmod(F.xxhash64(F.col(name)), F.lit(1024)).cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))

    return F.array(*[coordinate(d) + jitter for d in dims])


def _text() -> F.Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _size() -> F.Column:
    return (F.octet_length(_text()) + 16).cast("long")


def _hash() -> F.Column:
    return F.xxhash64(F.col("doc_id"), _text())


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows, written, whose hash (ROW) is made a row's own: of equal rows, numbered in parallel by written part, each gets another."""
    ties = table(rows.groupBy(ROW).agg(F.count("*").alias("n")).where("n > 1").select(ROW), "ties")
    if ties.isEmpty():
        drop(ties)
        return rows
    marked = rows.withColumn("_part", F.spark_partition_id()).join(sent_if_small(ties.withColumn("_tie", F.lit(True))), ROW, "left")
    marked = table(marked, "marked")
    tied = marked.where("_tie").withColumn("_at", F.row_number().over(W.partitionBy(ROW, "_part").orderBy("size")))
    counts = tied.groupBy(ROW, "_part").agg(F.count("*").alias("n"))
    before = counts.select(ROW, "_part", (F.sum("n").over(W.partitionBy(ROW).orderBy("_part")) - F.col("n")).alias("_before"))
    tied = tied.join(before, [ROW, "_part"]).withColumn(ROW, F.xxhash64(ROW, F.col("_before") + F.col("_at")))
    return table(marked.where("_tie IS NULL").select(*rows.columns).unionByName(tied.select(*rows.columns)), "rows")


def shard(docs: DataFrame, shards: int | None = None, dims: tuple[str, ...] = DIMS, rows_per_slot_group: int = 4096, target_bytes: int = 256 << 20) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs.

    There are `shards` leaves or, where that is None, as many as bring each to
    `target_bytes`. size is the text's UTF-8 bytes plus 16 (null text: 16). The
    tree takes `dims` as coordinates: numbers as they are, anything else by a
    hash of its value; a missing value, or a column that docs lacks, is 0. A
    hash of the row, below 1, is added to each coordinate, so that ties split
    too and equal values may lie on both sides of a cut; equal rows, null ids
    too, are numbered and get a hash each. No rows give no rows. slot runs from
    0 in each shard by doc_id within hashed groups, which are numbered in
    parallel and moved by the prefix sums of their counts.
    """
    plain = docs.select("doc_id", _size().alias("size"), F.crc32(_text().cast("binary")).alias("text_crc32"), _hash().alias(ROW), *[F.col(d).alias(f"__lk_d{i}") for i, d in enumerate(dims) if d in docs.columns])
    names = {d: f"__lk_d{i}" for i, d in enumerate(dims)}
    rows = _told_apart(table(plain, "metadata"))
    coords = _coordinates(rows, tuple(names[d] for d in dims), F.col(ROW))
    rows = rows.select("doc_id", "size", "text_crc32", ROW, coords.alias(COORDS))
    shards = shards_for(rows, shards, target_bytes)
    tree = kd_tree(rows, len(dims), shards)
    placed = routed(rows, tree, _subtrees(rows, tree, len(dims)), "shard").select("doc_id", "size", "text_crc32", ROW, "shard")
    parts = max(8, -(-rows.count() // (shards * rows_per_slot_group)))
    placed = placed.withColumn("_part", F.pmod(ROW, F.lit(parts)))
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "_part", (F.sum("n").over(W.partitionBy("shard").orderBy("_part")) - F.col("n")).alias("_before"))
    order = W.partitionBy("shard", "_part").orderBy(doc_key(), ROW)
    return placed.withColumn("_at", F.row_number().over(order)).join(before, ["shard", "_part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_at") - 1).alias("slot"))


def assign(docs: DataFrame, shards: int | None, dims: tuple[str, ...] = DIMS, target_bytes: int = 256 << 20, name: str = "shard") -> DataFrame:
    """The rows of docs, all columns, and their shard, in a column of that name (an error if docs has one); the texts themselves are not shuffled.

    As shard(), but each of equal rows falls in a shard by its place in the
    input. Null ids, null and empty texts are rows like others; no rows give no
    rows.
    """
    if name in docs.columns:
        raise ValueError(f"docs has a column {name!r}; give another name")
    picked = docs.select(_size().alias("size"), _hash().alias(ROW), *[F.col(d).alias(f"__lk_d{i}") for i, d in enumerate(dims) if d in docs.columns])
    written = table(picked, "metadata")
    rows = _told_apart(written)
    rows = rows.select("size", _coordinates(rows, tuple(f"__lk_d{i}" for i in range(len(dims))), F.col(ROW)).alias(COORDS))
    tree = kd_tree(rows, len(dims), shards_for(rows, shards, target_bytes))
    ties = table(written.groupBy(ROW).agg(F.count("*").alias("n")).where("n > 1").select(ROW, F.lit(True).alias("__lk_tie")), "ties")
    own = docs.withColumn(ROW, _hash())
    if not ties.isEmpty():
        place = F.xxhash64(F.col(ROW), F.monotonically_increasing_id())
        own = own.join(sent_if_small(ties), ROW, "left").withColumn(ROW, F.when(F.col("__lk_tie"), place).otherwise(F.col(ROW)))
    own = own.select(*[F.col(f"`{c}`") for c in docs.columns], _coordinates(docs, dims, F.col(ROW)).alias(COORDS))
    out = routed(own, tree, _subtrees(rows, tree, len(dims)), name)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], name)
