"""Near-duplicate texts: candidates by SimHash and by MinHash, links by the exact similarity of word shingles.

Fingerprints here weigh each word by 1 + ln(times), so that a few edits move
few bits; added or cut text moves more bits than the radius, so texts also meet
by the minima of their shingles' hashes. A sketch of minima estimates how far a
candidate is from the text that it meets, and what cannot be alike is parted
before candidates are closed into components, so loose likeness does not run
through the corpus. What remains is only a candidate component. Inside it texts
are linked by the Jaccard similarity of their sets of word shingles, computed
exactly in tasks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, connected_components, doc_key, drop, keyed, packed_texts, sent_if_small, table, text_key, unpack
from .embeddings import forest
from .repeats import HOT, mixed
from .simhash import links, shingle_hashes

WORDS, SIMILARITY, RADIUS = 5, 0.8, 6
#: Texts that a task compares with each other.
CHUNK = 256
#: Minima in a band's key, and the odds at which a pair of exactly the wanted similarity may share no key.
MINIMA, MISSED = 5, 1e-9
#: Minima, of a byte each, in a text's sketch; standard deviations that an estimate of it may be off; rounds that part the texts of a key.
SKETCH, SIGMAS, ROUNDS = 160, 5.0, 2
#: Width of the bins of estimated distances.
BIN = 0.05


def weighed_print(text: bytes) -> int:
    """Bit j is set if the words whose hash has it weigh over half; without words 0."""
    h = shingle_hashes(text, 1)
    if not len(h):
        return 0
    word, times = np.unique(h, return_counts=True)
    weight = 1 + np.log(times)
    total = np.zeros(64)
    for at in range(0, len(word), 65536):
        bits = np.unpackbits(word[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += weight[at : at + 65536] @ bits
    return int(((2 * total > weight.sum()).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def bands(least: float) -> int:
    """Keys of a text: a pair of similarity `least` shares each with odds least^MINIMA, so it shares none with odds of at most MISSED."""
    return 1 if least >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(least**MINIMA)))


def band_keys(hashes: np.ndarray, n: int) -> tuple[np.ndarray, bytes]:
    """n keys, each of the minima of the hashes in MINIMA orders, and the sketch; texts without shingles have the same ones."""
    seeds = mixed(np.arange(1, 2 * n * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
    low = np.full(n * MINIMA, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 256):
        low = np.minimum(low, ((hashes[at : at + 256, None] ^ seeds[0]) * (seeds[1] | np.uint64(1))).min(0))
    key = np.arange(n, dtype=np.uint64)
    for column in low.reshape(n, MINIMA).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key, (mixed(low[:SKETCH]) & np.uint64(255)).astype(np.uint8).tobytes()


def gap(least: float, n: int) -> int:
    """Bins by which the distances of two alike texts from a third differ at most, in a sketch of the minima of n keys.

    One minus the Jaccard similarity is a metric, so alike texts are at most
    1 - least apart in it; each estimate is off by SIGMAS deviations at most.
    """
    off = SIGMAS * math.sqrt(2 * 0.25 / min(SKETCH, n * MINIMA))
    return math.ceil((1 - least + off) / BIN) + 1


TEXTS = "did long, tk long, t1 long, t2 long, fp long, keys array<long>, sketch binary"


def _describe(words: int, n: int):
    def run(batches):
        for b in batches:
            texts = [t or b"" for t in as_bytes(b.column(2))]
            digest = np.array([divmod(xxhash.xxh3_128_intdigest(t), 1 << 64) for t in texts], np.uint64).reshape(-1, 2)
            fp = np.array([weighed_print(t) for t in texts], np.uint64)
            bands = [band_keys(np.unique(shingle_hashes(t, words)), n) for t in texts]
            keys, sketches = pa.array([k.view(np.int64) for k, _ in bands], pa.list_(pa.int64())), pa.array([x for _, x in bands], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (digest[:, 0], digest[:, 1], fp)], keys, sketches], names=[x.split()[0] for x in TEXTS.split(", ")])

    return run


def _far(batches):
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (2, 3))
        apart = (x != y).mean(1) if b.num_rows else np.zeros(0)
        # a byte agrees by chance once in 256
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((np.minimum(1, apart * 256 / 255) / BIN).astype(np.int32))], names=["low", "head", "bin"])


def distances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """low, head, bin of the estimated distance of each pair (low, head). nodes: head, sketch."""
    sketch = nodes.select("head", "sketch")
    both = pairs.join(sketch, "head").join(sketch.select(F.col("head").alias("low"), F.col("sketch").alias("hub")), "low")
    return table(both.select("low", "head", "sketch", "hub").mapInArrow(_far, "low long, head long, bin int"), "distances")


def _met(rows: DataFrame) -> DataFrame:
    """key, low (the smallest node of the key, its hub) and head of each row of a key with several.

    Keys of over HOT nodes are sent to every task where they are few, so that
    thousands of near copies need not meet in one; the others are joined by shuffle.
    """
    first = table(rows.groupBy("key").agg(F.min("head").alias("low"), F.count("*").alias("n")).where("n > 1"), "bands")
    # one row that is not hot keeps the plan's form the same with and without large keys
    none = rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit(-1).cast("long").alias("low"), F.lit(False).alias("hot"))
    hot = table(first.where(F.col("n") > HOT).select("key", "low", F.lit(True).alias("hot")).unionByName(none), "hot")
    tagged = rows.join(sent_if_small(hot), "key", "left")
    rest = tagged.where("hot IS NULL OR NOT hot").select("head", "key").join(first.where(F.col("n") <= HOT).select("key", "low"), "key")
    found = table(tagged.where("hot").select("key", "low", "head").unionByName(rest.select("key", "low", "head")), "met")
    drop(first, hot)
    return found


def band_links(nodes: DataFrame, apart: int) -> DataFrame:
    """head, other: links that connect the nodes of each key which may be alike. nodes: head, keys, sketch; apart: see gap().

    In the order of their distances from the hub, nodes of a key before and
    after a gap of `apart` bins cannot be alike. Those up to the first gap are
    linked to the hub; the others are dealt again, with a hub of their own, for
    ROUNDS rounds, and what then is left is linked without an estimate.

    A node is linked to the smallest of its hubs only, and that to the others,
    so a large group has about one link a node and not one a key.
    """
    rows, near, done = nodes.select("head", F.explode("keys").alias("key")), [], []
    for _ in range(ROUNDS):
        found = _met(rows)
        done.append(found)
        if found.isEmpty():
            break
        far = distances(found.where("head <> low").select("low", "head").distinct(), nodes)
        binned = table(found.join(far, ["low", "head"], "left").withColumn("bin", F.coalesce("bin", F.lit(0))), "binned")
        done += [far, binned]
        # at most 1 / BIN + 1 bins a key
        reach = F.aggregate(F.sort_array(F.collect_set("bin")), F.lit(0), lambda upto, b: F.when(b - upto < apart, b).otherwise(upto))
        cuts = binned.groupBy("key").agg(reach.alias("upto"), F.max("bin").alias("last")).where("last > upto").select("key", "upto")
        none = binned.sparkSession.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit(None).cast("int").alias("upto"))  # as in _met
        cuts = table(cuts.unionByName(none), "cuts")
        done.append(cuts)
        parted = binned.join(sent_if_small(cuts), "key", "left")
        near.append(parted.where("upto IS NULL OR bin <= upto").select("low", "head"))
        rows = parted.where("bin > upto").select("head", "key")
    else:
        near.append(_met(rows).select("low", "head"))
    out = nodes.select(F.col("head").alias("low"), "head").where("false")
    for x in near:
        out = out.unionByName(x)
    hubs = table(out.groupBy("head").agg(F.min("low").alias("hub"), F.collect_set("low").alias("lows")), "hubs")
    drop(*done)
    ends = hubs.select("hub", F.col("head").alias("other")).unionByName(hubs.select("hub", F.explode("lows").alias("other")))
    return table(ends.where("hub <> other").select(F.col("hub").alias("head"), "other").distinct(), "links")


def similar(texts: list[bytes], words: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices, i < j, whose sets of shingles have a Jaccard similarity of at least `least`; two texts without words are alike."""
    sets = [np.unique(shingle_hashes(t, words)) for t in texts]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, at, times = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = np.zeros((len(sets), len(sets)), np.float32)
    common = times[at] > 1
    column = np.unique(at[common], return_inverse=True)[1]
    owner = owner[common]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, z = np.searchsorted(column, [lo, lo + 4096])
        grid = np.zeros((len(sets), 4096), np.float32)
        grid[owner[a:z], column[a:z] - lo] = 1
        shared += grid @ grid.T
    union = size[:, None] + size[None, :] - shared
    return np.nonzero(np.triu((shared >= least * union) & ((union > 0) | (size[:, None] == size[None, :])), 1))


LINKED = "head long, other long"


def _verify(words: int, least: float):
    def run(key, t):
        node = t["node"].to_numpy()
        one = np.unique(node, return_index=True)[1]
        node, z, n = node[one], t["z"].take(pa.array(one)).to_pylist(), t["n_bytes"].to_numpy()[one]
        i, j = similar([unpack(x, int(k)) for x, k in zip(z, n)], words, least)
        edges = np.array(forest(i, j), np.int64).reshape(-1, 2)
        return pa.table([pa.array(node[edges[:, 0]], pa.int64()), pa.array(node[edges[:, 1]], pa.int64())], names=["head", "other"])

    return run


def verified(members: DataFrame, words: int, least: float) -> DataFrame:
    """head, other: links that connect what similar texts of a candidate component connect. members: root, node, m, n_bytes, z.

    Chunks of a component, each with its first text, are compared in one task
    each; that is all for a component of one chunk. In a larger one, texts that
    are not yet linked to the first are compared with every chunk.
    """
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    dealt = table(members.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")), "members")
    first = dealt.where("node = root AND chunks > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    found = table(dealt.unionByName(first).select("root", "chunk", "node", "n_bytes", "z").groupBy("root", "chunk").applyInArrow(_verify(words, least), LINKED), "verified")
    large = dealt.where("chunks > 1")
    if large.isEmpty():
        return found
    ends = connected_components(found, "head", "other")
    alone = large.join(ends.select("node", F.col("root").alias("end")), "node", "left").where("end IS NULL OR end <> root").drop("end")
    alone = alone.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    parts = table(alone.select("root", "part").distinct(), "parts")
    theirs = alone.select("root", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", "n_bytes", "z")
    others = large.join(parts, "root").select("root", "part", "chunk", "node", "n_bytes", "z")
    more = theirs.unionByName(others).groupBy("root", "part", "chunk").applyInArrow(_verify(words, least), LINKED)
    return found.unionByName(table(more, "verified"))


def groups(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """did, tk, t1, t2, first of every row of docs: first is true for the text that stands for its near-duplicate group.

    Each different text is a node with a number of its own, whatever its ids;
    the group's first is its smallest id's, or of several such texts the one
    with the smallest hash.
    """
    n = bands(least)
    texts = table(keyed(docs).mapInArrow(_describe(words, n), TEXTS), "texts")
    nodes = texts.groupBy("t1", "t2", "tk", "fp").agg(F.min("did").alias("head"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sketched = nodes.select(F.col("node").alias("head"), "keys", "sketch")
    # the keys alone find what is alike, so links of prints that the sketches rule out can go
    heads = table(nodes.groupBy("fp").agg(F.min("node").alias("head")), "prints")
    ends = links(heads, radius).select(F.col("head").alias("low"), F.col("other").alias("head"))
    ends = ends.unionByName(nodes.select("fp", "node").join(heads.withColumnRenamed("head", "low"), "fp").where("node <> low").select("low", F.col("node").alias("head")))
    prints = distances(ends, sketched).where(F.col("bin") < gap(least, n))
    met = prints.select(F.col("low").alias("head"), F.col("head").alias("other")).unionByName(band_links(sketched, gap(least, n)))
    near = table(connected_components(met, "head", "other").select("node", "root"), "candidates")
    sizes = table(near.groupBy("root").agg(F.count("*").alias("m")), "sizes")
    wanted = near.join(sizes, "root").join(nodes.select("node", F.col("head").alias("did"), "tk"), "node")
    members = packed_texts(docs).join(wanted, ["did", "tk"]).select("root", "node", "m", "n_bytes", "z").dropDuplicates(["node"])
    ends = table(connected_components(verified(members, words, least), "head", "other").select("node", "root"), "ends")
    firsts = ends.join(nodes, "node").groupBy("root").agg(F.min(F.struct("head", "t1", "t2")).alias("x"))
    firsts = ends.join(sent_if_small(table(firsts, "firsts")), "root").select("node", "x")
    same = (F.col("x.head") == F.col("head")) & (F.col("x.t1") == F.col("t1")) & (F.col("x.t2") == F.col("t2"))
    named = nodes.join(firsts, "node", "left").select("t1", "t2", "head", F.coalesce(same, F.lit(True)).alias("stands"))
    return texts.join(named, ["t1", "t2"]).select("did", "tk", "t1", "t2", (F.col("stands") & (F.col("did") == F.col("head"))).alias("first"))


def deduplicate(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, without those that near-duplicate a row with a smaller id.

    Texts are alike whose sets of `words`-word shingles have a Jaccard
    similarity of at least `least`, or that are linked through others; equal
    texts, empty and null ones too, are alike. Of alike rows that share the
    smallest id, null or not, one stays: the one whose text has the smallest
    hash. A null id counts as smaller than any other; no rows give no rows.
    """
    found = table(groups(docs, words, least, radius), "groups")
    gone = found.where("NOT first").select(F.col("did").alias("__lk_did"), F.col("tk").alias("__lk_tk")).distinct()
    kept = docs.join(gone, (doc_key() == F.col("__lk_did")) & (text_key() == F.col("__lk_tk")), "left_anti")
    if not found.where("first").groupBy("did", "t1", "t2").count().where("count > 1").isEmpty():
        kept = kept.withColumn("__lk_text", F.coalesce("text", F.lit(""))).dropDuplicates(["doc_id", "__lk_text"]).drop("__lk_text")
    return kept
