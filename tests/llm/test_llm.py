"""The operators against brute force, on awkward rows, empty tables and skewed groups."""

import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus  # noqa: E402
from larkspan.llm import common, embeddings, mixing, neardup, ngrams, quality, queries, repeats, sharding, simhash, suffixes, superkmer, templates, tokens  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import assert_same  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), SMALL, queries.SQL[name])


# Sharding


def test_shards_are_even_and_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.shard(docs, 40).collect()
    size, slots = Counter(), {}
    for r in out:
        size[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    largest = max(r["size"] for r in out)
    assert len(size) == 40 and max(size.values()) - min(size.values()) <= largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r["size"] == len(texts[r.doc_id]) + 16 for r in out)
    again = sharding.shard(docs.repartition(7), 40)
    assert rows_of(again, "doc_id", "shard", "slot") == sorted(((r.doc_id, r.shard, r.slot) for r in out), key=str)


def test_shards_of_awkward_rows(spark):
    out = sharding.shard(corpus.frame(spark), 4)
    got = out.collect()
    assert len(got) == len(corpus.texts()) and {r.shard for r in got} <= set(range(4))
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r["size"] for r in got if r.doc_id == 7} == {16}
    assert sharding.shard(corpus.empty(spark), 4).count() == 0
    by_size = sharding.shard(corpus.frame(spark), target_bytes=10_000).collect()
    assert len({r.shard for r in by_size}) == -(-sum(r["size"] for r in by_size) // 10_000)
    with pytest.raises(ValueError):
        sharding.assign(corpus.frame(spark), 4)
    whole = sharding.assign(corpus.frame(spark), 4, name="leaf")
    assert whole.count() == len(corpus.texts()) and whole.columns == [*corpus.empty(spark).columns, "leaf"]
    assert sharding.assign(corpus.empty(spark), 4, name="leaf").count() == 0


def plain_tree(rows, first, leaves, box, width):
    """Shard of each (id, size, coordinates), split at the weighted median along the widest side of the box."""
    if leaves == 1 or not rows:
        return {k: first for k, _, _ in rows}
    d = max(range(len(width)), key=lambda d: (box[d][1] - box[d][0]) / width[d])
    rows = sorted(rows, key=lambda r: r[2][d])
    left = leaves // 2
    goal, upto, best = sum(r[1] for r in rows) * left / leaves, 0, (float("inf"), 0)
    for k in range(len(rows) + 1):
        best = min(best, (abs(upto - goal), k))
        upto += rows[k][1] if k < len(rows) else 0
    cut = rows[best[1]][2][d] if best[1] < len(rows) else box[d][1]
    part = lambda side: [side if i == d else b for i, b in enumerate(box)]
    low, high = part((box[d][0], cut)), part((cut, box[d][1]))
    return plain_tree(rows[: best[1]], first, left, low, width) | plain_tree(rows[best[1] :], first + left, leaves - left, high, width)


@pytest.mark.parametrize("top", [4096, 4])
def test_shards_against_a_plain_tree(spark, monkeypatch, top):
    monkeypatch.setattr(sharding, "TOP", top)
    monkeypatch.setattr(sharding, "TOLERANCE", 0)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.s, r.c) for r in docs.select("doc_id", sharding._size().alias("s"), sharding._coordinates(docs, sharding.DIMS, sharding._hash()).alias("c")).collect()]
    box = [(min(r[2][d] for r in rows), max(r[2][d] for r in rows)) for d in range(4)]
    want = plain_tree(rows, 0, 13, box, [high - low for low, high in box])
    got = {r.doc_id: r.shard for r in sharding.shard(docs, 13).collect()}
    size = {r[0]: r[1] for r in rows}
    load = lambda shards: [sum(size[k] for k in shards if shards[k] == s) for s in range(13)]
    if top == 4096:
        assert got == want
    assert max(load(got)) <= max(load(want)) + max(size.values())
    assert {r.leaf: r.n for r in sharding.assign(docs, 13, name="leaf").groupBy("leaf").agg(F.count("*").alias("n")).collect()} == Counter(got.values())


def test_thousands_of_shards_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TOP", 64)
    rows = [(None if k % 3 == 0 else k, "same text" if k % 3 == 0 else f"text {k}") for k in range(6000)]
    sizes = Counter()
    for r in sharding.shard(corpus.frame(spark, rows), 1000, dims=("doc_id", "n_chars")).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 1000 and max(sizes.values()) <= 9 * 26
    few = Counter(r.leaf for r in sharding.assign(corpus.frame(spark, rows), 8, name="leaf").collect())
    assert len(few) == 8 and max(few.values()) < 900


def test_many_ties_split(spark):
    same = corpus.frame(spark, [(i, "same text") for i in range(64)])
    sizes = Counter(r.shard for r in sharding.shard(same, 8, dims=("lang", "n_chars")).collect())
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2


# SimHash


def test_covering_masks_cover():
    rnd = np.random.default_rng(1)
    for radius in (1, 3, 5, 6):
        for free in (2**64 - 1, 2**64 - 1 - (2**20 - 1)):
            masks = simhash.covering_masks(radius, free)
            assert all(masks) and len(masks) <= 2 ** (radius + 1) - 1
            places = [i for i in range(64) if free >> i & 1]
            for _ in range(200):
                flip = sum(1 << int(i) for i in rnd.choice(places, radius, replace=False))
                assert any(not m & flip for m in masks)


def _expected_components(rows, n=3, radius=3):
    prints = [brute.print_of(t, n) for _, t in rows]
    key = [common.NO_ID if i is None else i for i, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: key[k])
    linked = [(a, b) for x, a in enumerate(order) for b in order[:x] if (prints[a] ^ prints[b]).bit_count() <= radius or prints[a] == prints[b]]
    ranked = {k: x for x, k in enumerate(order)}
    top = brute.components(len(rows), [(ranked[a], ranked[b]) for a, b in linked])
    back = lambda k: None if key[k] == common.NO_ID else key[k]
    return sorted(((rows[k][0], f"{prints[k]:016x}", back(order[top[ranked[k]]])) for k in range(len(rows))), key=str)


def test_simhash_components(spark):
    assert rows_of(simhash.components(corpus.frame(spark))) == _expected_components([r for r in corpus.texts()])
    assert simhash.components(corpus.empty(spark)).count() == 0


def test_overfull_buckets_are_dealt_again(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    centre = int(rnd.integers(0, 2**63))
    fps = {centre}
    while len(fps) < 300:
        fps.add(centre ^ sum(1 << int(i) for i in rnd.choice(64, rnd.integers(1, 7), replace=False)))
    fps = [f if f < 2**63 else f - 2**64 for f in sorted(fps)]
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, head long").repartition(5)
    u = [f % 2**64 for f in fps]
    want = brute.components(len(u), [(a, b) for a in range(len(u)) for b in range(a) if (u[a] ^ u[b]).bit_count() <= 3])
    for bucket in (4, 2048):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        found = simhash.links(nodes, 3).collect()
        assert all((u[r.head] ^ u[r.other]).bit_count() <= 3 for r in found)
        assert brute.components(len(u), [(r.head, r.other) for r in found]) == want


@pytest.mark.parametrize(("hub", "sent"), [(512, 50_000), (2, 50_000), (2, 3)])
def test_components_of_paths_and_stars(spark, monkeypatch, hub, sent):
    monkeypatch.setattr(common, "HUB", hub)
    monkeypatch.setattr(common, "SENT_ROWS", sent)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (201, 200)]
    # stars whose middle is the smallest, in between or the largest node, two of them joined; -1 and the smallest long among the nodes
    edges += [(-1, -i) for i in range(2, 20)] + [(300, 301 + i) for i in range(30)] + [(350, 320 + i) for i in range(20)] + [(430, 410 + i) for i in range(40) if i != 20] + [(common.NO_ID, 500 + i) for i in range(9)]
    want = {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200, **{-i: -19 for i in range(1, 20)}, **{i: 300 for i in range(300, 340)}, 350: 300}
    want |= {i: 410 for i in range(410, 450)} | {i: common.NO_ID for i in [common.NO_ID, *range(500, 509)]}
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_edges_of_a_hub_are_spread(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        star = spark.range(1, 4001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
        out = common.with_least(star.unionByName(star.select(F.col("v").alias("u"), F.lit(0).cast("long").alias("v"))))[0]
        rows = out.groupBy((F.col("u") == 0).alias("hub"), F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("m").alias("lo"), F.max("m").alias("hi")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all((r.lo, r.hi) == ((1, 1) if r.hub else (0, 0)) for r in rows)
    assert sum(r.n for r in rows if r.hub) == 4000 and max(r.n for r in rows if r.hub) < 700


# Repeats


@pytest.mark.parametrize("hot", [2, 512])
def test_words_removed(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus.texts()
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute.removed_words(rows, 20))), key=str)
    assert rows_of(superkmer.deduplicate(corpus.frame(spark), 20)) == want


@pytest.mark.parametrize("hot", [2, 512])
def test_bytes_removed(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(suffixes, "RIVALS", hot)
    rows = corpus.texts()
    assert rows_of(suffixes.deduplicate(corpus.frame(spark), 400)) == removed_bytes(rows)


def removed_bytes(rows):
    """What the operator returns: the removals at 400 bytes, and the bytes repeated at 256."""
    texts = [t for _, t in rows]
    return sorted(((i, *x, y[1]) for (i, _), x, y in zip(rows, brute.removed_bytes(texts, 400), brute.removed_bytes(texts, 256))), key=str)


def test_repeats_of_nothing(spark):
    assert superkmer.deduplicate(corpus.empty(spark)).count() == 0 and suffixes.deduplicate(corpus.empty(spark)).count() == 0


@pytest.mark.parametrize("shared", [None, 3])
def test_repeats_among_texts_that_share_an_id(spark, shared):
    rnd = np.random.default_rng(21)
    prose = lambda n: " ".join(f"w{x}" for x in rnd.integers(0, 10**6, n))
    rows = [(shared, prose(110) if k % 2 else " ".join([prose(60)] * 2)) for k in range(10_000)]
    rows += [(k, rows[k][1]) for k in range(0, 400, 2)]
    assert rows_of(suffixes.deduplicate(corpus.frame(spark, rows), 400)) == removed_bytes(rows)
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute.removed_words(rows, 20))), key=str)
    assert rows_of(superkmer.deduplicate(corpus.frame(spark, rows), 20)) == want


def test_common_passage_in_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 8)
    monkeypatch.setattr(suffixes, "RIVALS", 8)
    passage = " ".join(f"w{i}" for i in range(120))
    rows = [(i, f"a{i} b{i * i} " + passage + f" c{i} d{i % 3}") for i in range(40)]
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute.removed_words(rows, 20))), key=str)
    assert rows_of(superkmer.deduplicate(corpus.frame(spark, rows))) == want
    assert rows_of(suffixes.deduplicate(corpus.frame(spark, rows))) == removed_bytes(rows)


def test_stretches_of_long_texts_join(monkeypatch):
    data = np.frombuffer(os.urandom(5000) * 2, np.uint8)
    whole = {s + k for _, _, first, count in suffixes.blocks(data, 400, 64) for s0, c in zip(first, count) for s, k in [(int(s0), j) for j in range(int(c))]}
    monkeypatch.setattr(suffixes, "STRETCH", 700)
    cut = {s + k for _, _, first, count in suffixes.blocks(data, 400, 64) for s0, c in zip(first, count) for s, k in [(int(s0), j) for j in range(int(c))]}
    assert whole == cut == set(range(len(data) - 399))


def test_multikey_quicksort():
    rnd = np.random.default_rng(2)
    rows = rnd.integers(0, 3, (500, 32), dtype=np.uint8)
    rows[100:300, :24] = rows[0, :24]
    order = suffixes.multikey_quicksort(rows)
    assert sorted(r.tobytes() for r in rows) == [rows[i].tobytes() for i in order]
    near = suffixes.neighbours(rows, order)
    for k in range(1, 500):
        a, b = rows[order[k - 1]].tobytes(), rows[order[k]].tobytes()
        assert near[k] == len(os.path.commonprefix([a, b]))


def test_sliding_min():
    x = np.random.default_rng(4).integers(0, 1000, 97).astype(np.uint64)
    for w in (1, 2, 10, 97):
        assert suffixes.sliding_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(97 - w + 1)]


# Near-duplicates with exact similarity


def _groups(rows, least=0.8):
    key = [common.NO_ID if i is None else i for i, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: key[k])
    linked = [(a, b) for a in range(len(order)) for b in range(a) if brute.jaccard(rows[order[a]][1], rows[order[b]][1]) >= least]
    top = brute.components(len(order), linked)
    return {order[k] for k in range(len(order)) if top[k] == k}


@pytest.mark.parametrize("chunk", [2, 256])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    rows = corpus.texts()
    base = rows[0][1].split()
    for k in range(12):
        w = list(base)
        w[10 * k + 3] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    out = neardup.deduplicate(corpus.frame(spark, rows))
    assert out.columns == corpus.empty(spark).columns
    kept = [rows[k] for k in _groups(rows)]
    assert rows_of(out, "doc_id", "text") == sorted(kept, key=str)
    assert neardup.deduplicate(corpus.empty(spark)).count() == 0


def test_added_and_cut_text_is_found(spark):
    rnd = np.random.default_rng(12)
    rows = []
    for k in range(60):
        w = [f"w{x}" for x in rnd.zipf(1.4, int(rnd.integers(60, 300))) % 3000]
        n = len(w)
        rows.append((k, " ".join(w)))
        rows.append((100 + k, " ".join(w[: n - n // 6] if k % 2 else w + [f"v{x}" for x in rnd.integers(0, 3000, n // 5)])))
    near = [k for k in range(60) if brute.jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8]
    assert len(near) > 40
    got = {r.doc_id for r in neardup.deduplicate(corpus.frame(spark, rows)).collect()}
    assert got == {i for i, _ in rows} - {100 + k for k in near}


def test_near_copies_without_ids(spark):
    rnd = np.random.default_rng(31)
    rows = []
    for k in range(8):
        w = [f"w{x}" for x in rnd.integers(0, 10**6, 150)]
        rows += [(None, " ".join(w)), (None, " ".join([*w[:75], "edited", *w[76:]])), (5, " ".join([*w, "more"]))]
    rows += [(None, None), (None, "")]
    kept = neardup.deduplicate(corpus.frame(spark, rows)).collect()
    assert len(kept) == 9 and {r.doc_id for r in kept} == {None}
    assert {r.text.split()[0] for r in kept if r.text} == {t.split()[0] for _, t in rows if t}


# Decontamination


def test_templates(spark):
    item = "John has 5 apples and gives 3 apples to Mary before John eats the 5 remaining ones"
    docs = [
        (1, "intro " + item + " end"),
        (2, "so we ask Peter has 9 apples and gives 4 apples to Anna before Peter eats the 9 remaining ones ok"),
        (3, "so we ask Peter has 9 apples and gives 4 apples to Anna before Anna eats the 7 remaining ones ok"),
        (4, "nothing of the kind is said in this text about apples or pears at all"),
        (5, None), (6, ""), (7, item.upper()), (None, item),
    ]
    bench = spark.createDataFrame([(70, item), (71, None), (72, "too short"), (73, ""), (70, item)], "item_id long, text string")
    for sent in (1 << 20, 0):
        got = templates.contaminated(corpus.frame(spark, docs), bench, sent_bytes=sent).collect()
        assert {r.doc_id for r in got} >= {1, 2, None} and not {r.doc_id for r in got} & {3, 4, 5, 6}
        assert {r.changed_slots for r in got if r.doc_id == 1} == {0} and min(r.changed_slots for r in got if r.doc_id == 2) > 0
        kept = templates.clean(corpus.frame(spark, docs), bench, sent_bytes=sent)
        assert {3, 4, 5, 6} <= {r.doc_id for r in kept.collect()} and kept.columns == corpus.empty(spark).columns
    assert templates.contaminated(corpus.empty(spark), bench).count() == 0
    assert templates.contaminated(corpus.frame(spark, docs), bench.where("item_id < 0")).count() == 0


def test_verbatim_items_of_any_kind(spark):
    items = ["John Smith met Mary Jones in New York City.", "Is 1234 5678 9012 3456 prime?", "Convert 5 km 300 m 20 cm to mm", "Barack Obama beat John McCain in November 2008", "How many apples does Tom have right now?", "Name Paris Rome", "Define entropy", "1 2 3 4 5 6 7 8 9 10 11 12"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(10 * k + j, before + t + after) for k, t in enumerate(items) for j, (before, after) in enumerate([("", ""), ("Quiz\n", "\nAnswer"), ("so we read ", " and went on"), ("Done. ", " Then more")])]
    docs += [(900, "John Smith met Mary Brown in New York City."), (901, "Is 1234 5678 9012 3457 prime?"), (902, "define the entropy"), (903, "1 2 3 4 5 6 7 8 9 10 11 13"), (904, "2 3 4 5 6 7 8 9 10 11 12")]
    for sent in (1 << 20, 0):
        got = rows_of(templates.contaminated(corpus.frame(spark, docs), bench, sent_bytes=sent), "doc_id", "item_id")
        assert got == sorted(((10 * k + j, k) for k in range(len(items)) for j in range(4)), key=str)


def test_clean_removes_rows_not_ids(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(None, f"a clean text of its own, number {k}, about nothing in particular") for k in range(5)] + [(None, "see: " + item), (3, item), (3, "another text with a repeated id and no item in it at all"), (4, None), (None, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for sent in (1 << 20, 0):
        kept = rows_of(templates.clean(corpus.frame(spark, rows), bench, sent_bytes=sent), "doc_id", "text")
        assert kept == sorted((r for r in rows if item not in (r[1] or "")), key=str)


def test_both_forms_keep_rows_apart(spark):
    item = "John has 5 apples and gives 3 apples to Mary before John eats the 5 remaining ones"
    names = [("Peter", "Anna", 9, 4), ("Paul", "Jane", 8, 2), ("Mark", "Lucy", 7, 6)]
    rows = [(i, f"so we ask {a} has {m} apples and gives {n} apples to {b} before {a} eats the {m} remaining ones ok") for a, b, m, n in names for i in (None, None, 3)]
    rows += [(None, "intro " + item + " end")] * 2 + [(None, "nothing of it")]
    bench = spark.createDataFrame([(70, item), (70, item), (None, item), (71, "some other item with 5 apples that nobody ever asks")], "item_id long, text string")
    sent, dealt = (rows_of(templates.contaminated(corpus.frame(spark, rows), bench, sent_bytes=k)) for k in (1 << 20, 0))
    assert sent == dealt and len(sent) == 33


def test_planted_passages_are_found_in_both_ways(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    a = rows_of(templates.contaminated(docs, bench))
    items = bench.collect()
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in items if b.text in d.text}
    assert {r[:2] for r in a} == want
    assert rows_of(templates.contaminated(docs, bench, sent_bytes=0)) == a


def test_reparameterised_items_against_brute_force(spark):
    rnd = np.random.default_rng(41)
    names, plain = ["Anna", "Peter", "Mary", "John", "Lucy", "Mark", "Jane", "Paul"], [f"w{k}" for k in range(400)]

    def item():
        who, n = rnd.permutation(names)[:2], rnd.permutation(90)[:2] + 10
        slots = {0: who[0], 4: str(n[0]), 7: who[1], 10: str(n[1]), 13: who[0], 16: str(n[0])}
        return [slots.get(k, plain[int(rnd.integers(400))]) for k in range(20)]

    def changed(words, consistent):
        """Other names and numbers, one for one or each time another."""
        out, known = [], {}
        for w in words:
            if w in names or w.isdigit():
                pool = [x for x in names if x not in known.values()] if w in names else [str(x) for x in range(100, 190) if str(x) not in known.values()]
                new = pool[int(rnd.integers(len(pool)))]
                w = known.setdefault(w, new) if consistent else known.setdefault((w, len(out)), new)
            out.append(w)
        return out

    items = [item() for _ in range(60)]
    rows = [(3 * k + j, "so we ask " + " ".join(t) + " and that is all") for k, w in enumerate(items) for j, t in enumerate((w, changed(w, True), changed(w, False)))]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.changed_slots for r in templates.contaminated(corpus.frame(spark, rows), bench).collect()}

    def brute_match(words, want):
        """Whether some place of the document has the item's words, and at least half of its windows, in turn, a one-to-one map of slots."""
        is_slot = lambda w: w in names or w.isdigit()
        for at in range(len(words) - len(want) + 1):
            here = words[at : at + len(want)]
            if all(x == y or (is_slot(x) and is_slot(y) and x.isdigit() == y.isdigit()) for x, y in zip(here, want)):
                there, back, held = {}, {}, 0
                for s in range(len(want) - 7):
                    t, b = dict(there), dict(back)
                    if all(t.setdefault(y, x) == x and b.setdefault(x, y) == y for x, y in zip(here[s : s + 8], want[s : s + 8]) if is_slot(y)):
                        there, back, held = t, b, held + 1
                if 2 * held >= len(want) - 7:
                    return True
        return False

    want = {(i, k) for i, t in rows for k, w in enumerate(items) if brute_match(t.split(), w)}
    assert set(got) == want and {(3 * k + j, k) for k in range(60) for j in (0, 1)} <= want
    assert all(got[3 * k + j, k] == sum(x != y for x, y in zip(rows[3 * k + j][1].split()[3:23], items[k])) for k in range(60) for j in (0, 1))
    assert len(want) < 170


# Mixing


@pytest.mark.parametrize("sizes", [[("b", 10), ("a", 1000), (None, 500), ("c", 5)], [("x", 0)], [(f"s{k}", k % 7 * 10 ** (k % 4)) for k in range(200)] + [(None, 3)], [("\U0001f600", 5), ("\uffee", 900), ("z", 1)]])
def test_targets(spark, sizes):
    ranked = sorted((k for k, _ in sizes), key=lambda k: (k is None, k or ""))
    size, total = dict(sizes), float(sum(s for _, s in sizes))
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(ranked)}
    want, left, open_ = {}, total, dict(weight)
    while open_:
        level = left / sum(open_.values())
        over = [k for k in open_ if weight[k] * level > 3 * size[k] + 1e-9]
        if not over:
            want |= {k: weight[k] * level for k in open_}
            break
        for k in over:
            want[k] = 3.0 * size[k]
            left -= want[k]
            del open_[k]
    df = spark.createDataFrame(sizes, "source string, s long").repartition(5)
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert {k: pytest.approx(v) for k, v in want.items()} == got and sum(got.values()) == pytest.approx(total)
    assert mixing.targets(df.where("s < 0")).count() == 0


def test_mix(spark):
    docs = corpus.frame(spark)
    out = mixing.mix(docs, rows_per_group=2).collect()
    assert len(out) == len(corpus.texts())
    by = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault((r.target, r.source_size), []).append(r)
    assert len(by) == docs.select("source").distinct().count()
    for (target, whole), rows in by.items():
        assert sum(r["size"] for r in rows) == whole and abs(sum(r.taken for r in rows) - target) <= 1
    assert sorted(map(tuple, out), key=str) == rows_of(mixing.mix(docs.repartition(9), rows_per_group=3))
    assert mixing.mix(corpus.empty(spark)).count() == 0
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns and mixing.draw(corpus.empty(spark)).count() == 0
    assert {r.doc_id for r in drawn.collect()} <= {i for i, _ in corpus.texts()}


# Language model


@pytest.mark.parametrize("order,cutoff", [(3, 1), (2, 2), (4, 2), (1, 1)])
def test_scores_of_awkward_rows(spark, order, cutoff):
    import math

    rows = corpus.texts()
    c = Counter()
    for _, t in rows:
        w = brute.words(t)
        for n in range(1, order + 1):
            c.update(zip(*(w[k:] for k in range(n))))
    total = sum(v for k, v in c.items() if len(k) == 1)

    def want(t):
        w, s, back, once = brute.words(t), 0.0, 0, 0
        for k in range(len(w)):
            longest = min(order, k + 1)
            n = next(n for n in range(longest, 0, -1) if n == 1 or c[tuple(w[k - n + 1 : k + 1])] >= cutoff)
            over = c[tuple(w[k - n + 1 : k])] if n > 1 else total
            s += math.log(0.4 ** (longest - n) * c[tuple(w[k - n + 1 : k + 1])] / over)
            back += n < longest
            once += c[tuple(w[k - longest + 1 : k + 1])] == 1
        return len(w), back, once, round(s, 6) if w else None

    got = ngrams.score(corpus.frame(spark), order, cutoff).select("doc_id", "n_words", "backed_off", "seen_once", F.round("log_score", 6))
    assert rows_of(got) == sorted(((i, *want(t)) for i, t in rows), key=str)
    assert ngrams.score(corpus.empty(spark), order, cutoff).count() == 0


def test_packed_ngrams_round_trip():
    h = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    n = np.arange(1000)
    a, b = ngrams.unpack(1000, ngrams.pack(h, n))
    assert (a == h).all() and (b == n).all()


# Embeddings


@pytest.mark.parametrize("block,bits", [(8, 0), (2048, 0), (16, 2), (2048, 5)])
def test_links_of_vectors(spark, monkeypatch, block, bits):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "cheapest_bits", lambda n, threshold: bits)
    rnd = np.random.default_rng(6)
    base = rnd.standard_normal((12, 16))
    rows = []
    for i in range(90):
        v = base[i % 12] + rnd.standard_normal(16) * rnd.choice([0.0, 0.1, 0.3])
        rows.append((1000 - i, v.tolist(), int(rnd.integers(0, 2))))
    rows += [(5, None, 0), (6, [0.0] * 16, 0), (7, [float("nan")] + [1.0] * 15, 0), (8, [None] + [1.0] * 15, 0), (9, [], 1), (10, [float("inf")] * 16, 1), (11, base[0].tolist(), None), (None, base[0].tolist(), 0), (12, [1.0, 2.0], 0), (13, [2.0, 4.0], 0), (14, [-0.0, 1.0], 0), (15, [0.0, 1.0], 0), (12, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    key = [common.NO_ID if r[0] is None else r[0] for r in rows]
    fine = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    pairs = set()
    for a in range(len(rows)):
        for b in range(a):
            if fine[a] and fine[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    pairs |= {(a, b), (b, a)}
    order = sorted(range(len(rows)), key=lambda k: key[k])
    rank = {k: x for x, k in enumerate(order)}
    top = brute.components(len(rows), [(rank[a], rank[b]) for a, b in pairs])
    want = []
    for k, r in enumerate(rows):
        root = key[order[top[rank[k]]]]
        want.append((r[0], sum(a == k for a, _ in pairs), None if root == common.NO_ID else root, key[k] == root))
    assert rows_of(embeddings.near_duplicates(df)) == sorted(want, key=str)
    assert embeddings.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_links_of_vectors_without_ids(spark):
    rows = [(None, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.01, 0.0], 0), (None, [0.0, 1.0, 0.0], 0), (4, [0.0, 1.0, 0.01], 0), (5, [0.0, 0.0, 1.0], 0), (6, [0.01, 0.0, 1.0], 0), (6, [-1.0, 0.0, 0.0], 0)]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert rows_of(out, "vec_id", "n_links", "component_id") == sorted([(None, 1, None)] * 3 + [(4, 1, None), (5, 1, 5), (6, 1, 5), (6, 0, 6)], key=str)


def test_estimates_are_unbiased_and_bounds_hold():
    rnd = np.random.default_rng(8)
    a = rnd.standard_normal((3000, 64))
    ua, ub = embeddings.units(a), embeddings.units(a + 0.38 * rnd.standard_normal(a.shape))
    ca, cb = embeddings.encode(ua), embeddings.encode(ub)
    found = {(int(x), int(y)) for i, j in embeddings.estimated_pairs(ca, cb, 0.93, False) for x, y in zip(i, j)}
    near = {(int(x), int(y)) for x, y in zip(*np.nonzero(ua @ ub.T >= 0.93))}
    assert near <= found and len(near) > 500 and len(found) < 0.01 * 3000**2
    code = (np.unpackbits(cb[0], axis=1).astype(float) * 2 - 1) / 8
    error = np.einsum("ij,ij->i", ca[2] * ca[3][:, None], code) / cb[1] - np.einsum("ij,ij->i", ua, ub)
    assert abs(error.mean()) < 0.005


def test_index_finds_links_and_grows_slower_than_pairs(spark, monkeypatch):
    rnd = np.random.default_rng(17)
    base = rnd.standard_normal((1500, 64))
    v = np.concatenate([base, base + 0.36 * rnd.standard_normal(base.shape)])
    u = embeddings.units(v)
    i, j = (x.tolist() for x in np.nonzero(np.triu(u @ u.T >= 0.93, 1)))
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(4)
    for bits, missed in ((8, 1e-6), (8, 0.05)):
        monkeypatch.setattr(embeddings, "cheapest_bits", lambda n, threshold: bits)
        monkeypatch.setattr(embeddings, "MISSED", missed)
        got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
        want = Counter(i + j)
        recall = sum(got.values()) / sum(want.values())
        assert len(i) > 300 and all(got[k] <= want[k] for k in got) and recall >= (1 - 1e-5 if missed < 1e-5 else 0.94)
    monkeypatch.undo()
    cost = lambda n: (lambda k: embeddings.tables(k, 0.93) * (n * n / 2 ** (k + 1) * embeddings.PAIR_COST + n * embeddings.ROW_COST))(embeddings.cheapest_bits(n, 0.93))
    assert embeddings.cheapest_bits(1e4, 0.93) == 0 and cost(1e10) / cost(1e8) < 100**1.3


# Tokens


@pytest.fixture(scope="module")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_files(spark, monkeypatch, tokenizer_path):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "BLOCK", 700)
    t = Tokenizer.from_file(tokenizer_path)
    rows = [r for r in corpus.texts()] + [(50, "It's ROCK'N'roll 3d <|endoftext|> <|ENDOFTEXT|> ΣΑΣ fin. «g».. …dots... 中文。文 été!! s' 'll \x00a ﬁne"), (51, "́ x  y")]
    ids = sorted(((common.NO_ID if i is None else i), t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in rows)
    want, at = [], 0
    out = tokens.round_trip(corpus.frame(spark, rows), tokenizer_path, 1).collect()
    assert sum(r.n_tokens for r in out) == sum(len(x) for _, x in ids)
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        want.append((common.NO_ID if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32))
    assert [w[0] for w in want] == [i for i, _ in ids]
    assert sorted(want) == sorted((i, len(x), crc(x)) for i, x in ids)
    assert tokens.round_trip(corpus.empty(spark), tokenizer_path, 1).count() == 0


def test_ids_of_random_texts(tokenizer_path):
    from tokenizers import Tokenizer

    rnd = np.random.default_rng(77)
    pool = [*"abcXYZ019'(),.;!?-_ \n\t", "\u0130", "\u0131", "\u00df", "\u03a3", "\u03c2", "\u00e9", "e\u0301", "\u0301", "\u1e9e", "\u01c4", "\ufb01", "\u212b", "\u4e2d", "\u3002", "\u0915", "\u093f", "\ud55c", "\u1112\u1161", "'s", "'ll", "\u00a0", "\u0085", "\u2003", "\u00b2", "\u2163", "\U0001f600", "\u200d", "\x00", "<|", "|>", "<|endoftext|>"]
    texts = ["".join(rnd.choice(pool, int(rnd.integers(1, 25)))) for _ in range(6000)]
    texts += [f"x\u0130{c} \u0130{c}{c}y" for c in tokens.PUNCTUATION.decode()]
    want = Tokenizer.from_file(tokenizer_path).encode_batch(texts, add_special_tokens=False)
    got = tokens.encode_texts([t.encode() for t in texts], tokenizer_path, 1)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids + [1] for e in want]


def test_other_tokenizers_encode_whole_texts(tmp_path, tokenizer_path):
    import json

    from tokenizers import Tokenizer

    rules = json.load(open(tokenizer_path, encoding="utf-8"))
    rules["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(rules))
    path = str(tmp_path / "other.json")
    texts = ["Some TEXT, with Case.", "", "x  y"]
    assert tokens.coder(path)[1] is None and tokens.coder(tokenizer_path)[1] is not None
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode_texts([t.encode() for t in texts], path, 1)] == [e.ids + [1] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_components_of_small_graphs_take_one_task(spark, monkeypatch):
    some = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in some.integers(-40, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(-(2**63), 5000), (7000, 7000)]
    edges = spark.createDataFrame(edges, "a long, b long")
    written = []
    monkeypatch.setattr(common, "table", lambda df, name, write=common.table: written.append(name) or write(df, name))
    small = sorted(map(tuple, common.connected_components(edges).collect()))
    assert written == ["edges", "roots"]
    assert common.connected_components(edges.where("false")).collect() == []
    monkeypatch.setattr(common, "SOLVED", 0)
    monkeypatch.setattr(common, "HUB", 4)
    assert sorted(map(tuple, common.connected_components(edges).collect())) == small
    assert common.trim(spark) in (True, False)


def test_a_worker_packs_its_words_after_encoding(tokenizer_path):
    texts = [" ".join(f"word{k} Other{k}, caf\u00e9{k}! <|x{k}" for k in range(2000)).encode(), b"", b"plain"]
    want = tokens.encode_texts(texts, tokenizer_path, 1)
    kept = tokens.coder(tokenizer_path)[2:]
    before = [dict(k) for k in kept]
    assert all(len(k) > 1000 for k in kept)
    list(tokens._histogram(iter([])))
    assert all(set(k) == {tokens.PACKED} for k in kept)
    tokens.rest()
    tokens.coder(tokenizer_path)
    assert [{w: x for w, x in k.items() if w} for k in kept] == [{w: x for w, x in k.items() if w} for k in before]
    tokens.rest()
    assert tokens.encode_texts(texts, tokenizer_path, 1) == want


def test_blocks_decode_alone_and_notice_damage():
    rnd = np.random.default_rng(9)
    ids = np.concatenate([rnd.zipf(1.3, 20_000) % 5000, [70_000, 1]])
    freq = tokens.Frequencies(dict(Counter(ids.tolist())))
    assert int(freq.f.sum()) == 1 << tokens.BITS
    block = tokens.encode_block(ids, [4, 9], [5, len(ids) - 5], freq)
    dids, n, back = tokens.decode_block(block, freq, freq.slots())
    assert dids.tolist() == [4, 9] and n.tolist() == [5, len(ids) - 5] and (back == ids).all()
    span = tokens.LANES * tokens.STEPS
    assert (tokens.decode_block(block, freq, freq.slots(), slice(2, 3))[2] == ids[2 * span : 3 * span]).all()
    assert len(block) < 2.2 * len(ids)
    broken = bytearray(block)
    broken[len(block) // 2] ^= 64
    with pytest.raises(ValueError):
        tokens.decode_block(bytes(broken), freq, freq.slots())
    with pytest.raises(ValueError):
        tokens.decode_block(b"x" * 100, freq, freq.slots())
    one = tokens.Frequencies({3: 10})
    assert (tokens.decode_block(tokens.encode_block(np.full(10, 3), [1], [10], one), one, one.slots())[2] == 3).all()


# Quality


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 3 = 0")
    model = quality.fit(quality.sample(docs, labels.where("doc_id % 3 <> 0")))
    start = quality._grader(model)
    import pyarrow as pa

    rows = docs.join(held, "doc_id").select("text", "quality", "toxic").collect()
    tails = start()(pa.array([r.text for r in rows]))
    keep = tails[:, 1] >= 0.5
    clean = np.array([r.quality == 1 and r.toxic == 0 for r in rows])
    toxic = np.array([r.toxic == 1 for r in rows])
    assert keep[clean].mean() > 0.96 and keep[toxic].mean() < 0.12 and keep[~clean & ~toxic].mean() < 0.25
    assert (tails[:, 0] >= tails[:, 1] - 1e-12).all() and model.t[0] < model.t[1]


def test_quality_of_awkward_rows(spark):
    docs = corpus.frame(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (17, 1, 1), (None, 1, 1), (3, None, 0), (99, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels)
    assert out.count() == len(corpus.texts())
    assert {r.kept for r in out.where("doc_id IN (7, 8, 9)").collect()} == {False} and all(0 <= r.expected_grade <= 2 for r in out.collect())
    assert quality.classify(corpus.empty(spark), labels).count() == 0
    alone = quality.select(docs, labels.where("doc_id < 0"))
    assert alone.columns == docs.columns and alone.count() == len(corpus.texts()) - 3


def test_grades_equal_a_plain_model(spark):
    rnd = np.random.default_rng(5)
    vocabulary = {0: ["bad", "vile"], 1: ["meh", "dull"], 2: ["good", "fine"]}
    rows = [(k, " ".join([*rnd.choice(vocabulary[k % 3], 3), *(f"w{x}" for x in rnd.integers(0, 50, 20))])) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 3 == 2), int(k % 3 == 0)) for k, _ in rows], "doc_id long, quality int, toxic int")
    docs = corpus.frame(spark, rows)
    model = quality.fit(quality.sample(docs, labels))
    assert (model.w != 0).any() and model.t[0] < model.t[1]
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    for k, text in rows:
        at, value = quality.features(text.encode(), {})
        score = sum(float(np.float32(model.w[a])) * v for a, v in zip(at, value))
        tail = [1 / (1 + np.exp(t - score)) for t in model.t]
        assert got[k].expected_grade == pytest.approx(sum(tail), abs=1e-4) and got[k].kept == (tail[1] >= 0.5) == (k % 3 == 2)


def test_the_fit_is_an_optimum(spark):
    rnd = np.random.default_rng(6)
    rows = [(np.array([k % 3, 7]), np.array([1.0, rnd.random()], np.float32), int(k % 3 if rnd.random() < 0.8 else rnd.integers(3))) for k in range(400)]
    model = quality.fit(rows, ridge=0.1)
    y = np.array([g for _, _, g in rows])
    weight = (1 / (np.bincount(y) / len(y))[y]) ** quality.EVEN
    weight /= weight.mean()

    def loss(w, t):
        x = np.array([sum(w[a] * v for a, v in zip(at, value)) for at, value, _ in rows])
        below = np.stack([np.zeros(len(x)), *[1 / (1 + np.exp(-(c - x))) for c in t], np.ones(len(x))])
        chance = below[y + 1, np.arange(len(x))] - below[y, np.arange(len(x))]
        return -(weight * np.log(chance)).mean() + 0.05 * (w @ w)

    best, used = loss(model.w, model.t), np.flatnonzero(model.w)
    for step in (1e-2, -1e-2):
        for k in used:
            w = model.w.copy()
            w[k] += step
            assert loss(w, model.t) >= best - 1e-7
        for k in range(2):
            t = model.t.copy()
            t[k] += step
            assert loss(model.w, t) >= best - 1e-7


# Long texts


def test_texts_of_over_a_megabyte(spark, tokenizer_path):
    from tokenizers import Tokenizer

    rnd = np.random.default_rng(9)
    item = "how many green apples does the tall farmer carry home"
    long = " ".join(f"w{x}" for x in rnd.zipf(1.3, 300_000) % 5000)
    rows = [(1, long + " " + item), (2, long + " " + item), (3, "short text " * 30), (4, None)]
    assert len(long) > 1 << 20
    docs = corpus.frame(spark, rows)
    prints = {r.doc_id: r for r in simhash.components(docs).collect()}
    assert prints[1].fingerprint == prints[2].fingerprint == f"{brute.print_of(rows[0][1]):016x}" and prints[2].component_id == 1
    scores = {r.doc_id: r for r in ngrams.score(docs).collect()}
    assert scores[1].n_words == 300_010 and scores[1].log_score == scores[2].log_score and scores[1].seen_once == 0
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert rows_of(templates.contaminated(docs, bench), "doc_id", "item_id") == [(1, 9), (2, 9)]
    ids = Tokenizer.from_file(tokenizer_path).encode(rows[0][1], add_special_tokens=False).ids + [1]
    out = {r.doc_id: r for r in tokens.round_trip(docs, tokenizer_path, 1).collect()}
    assert out[1].n_tokens == len(ids) and out[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and out[2].start == len(ids)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 4
    assert rows_of(superkmer.deduplicate(docs), "doc_id", "n_words")[0] == (1, 300_010)
    assert {r.doc_id for r in neardup.deduplicate(docs).collect()} == {1, 3, 4}
