"""Operators against pandas and NumPy on small frames with every awkward value, at several partitionings."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspan.operators import aggregate as A
from larkspan.operators import grid as G
from larkspan.operators import images as I
from larkspan.operators import joins as J
from larkspan.operators import select as P
from larkspan.operators import topk as K
from larkspan.sources import tables as T

PARTS = [1, 4, 17]
NAN = float("nan")
ROWS = [(1, "a", 1.0), (2, "a", NAN), (3, "b", None), (4, "b", 4.0), (5, None, 5.0), (6, "c", float("inf")), (7, "a", -0.0), (8, "d", 2.0)]


def frame(spark, parts=1, rows=ROWS):
    return spark.createDataFrame(rows, "id long, k string, v double").repartition(parts)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", PARTS)
def test_filters(spark, parts):
    df = frame(spark, parts)
    assert sorted(r.id for r in P.filter_greater(df, "v", 1.5).collect()) == [4, 5, 6, 8]
    assert sorted(r.id for r in P.is_in(df, "k", spark.createDataFrame([("a",), ("a",), (None,)], "x string")).collect()) == [1, 2, 5, 7]
    assert sorted(r.id for r in P.is_in(df, "k", ["b"]).collect()) == [3, 4]
    assert [(r.k, r["size"]) for r in P.having(df, ["k"], 2).orderBy("k").collect()] == [("a", 3), ("b", 2)]
    assert sorted(r.id for r in P.label_rows(df, "k", P.having(df, ["k"], 3)).collect()) == [1, 2, 7]
    assert P.length(P.positions(df, "id", 2, 5)) == 3
    assert [r.n for r in P.where_mask(df, P.negate(F.col("id") > 2)).agg(F.count("*").alias("n")).collect()] == [2]


@pytest.mark.parametrize("parts", PARTS)
def test_aggregates(spark, parts):
    df = frame(spark, parts)
    p = pd.DataFrame(ROWS, columns=["id", "k", "v"])
    got = {r.k: r.s for r in df.where("k IS NOT NULL").groupBy("k").agg(A.nan_sum("v").alias("s")).collect()}
    assert got == p.groupby("k").v.sum().to_dict()
    assert {r.k: r["size"] for r in A.group_size(df, ["k"]).collect()} == p.groupby("k").size().to_dict()
    std = {r.k: r["std"] for r in A.group_std(df.where("v < 100"), ["k"], "v").collect()}
    assert std["a"] == pytest.approx(p[p.k == "a"].v.std()) and std["d"] is None
    assert {r.k for r in A.unique(df, "k").collect()} == {"a", "b", "c", "d", None}
    assert df.where("id < 0").agg(A.nan_sum("v")).first()[0] == 0.0
    out = A.group_apply(df, ["k"], lambda f: pd.DataFrame({"k": [f.k.iloc[0]], "n": [len(f)]}), "k string, n long")
    assert {r.k: r.n for r in out.collect()} == {"a": 3, "b": 2, "c": 1, "d": 1}


@pytest.mark.parametrize("parts", PARTS)
def test_two_phase(spark, parts):
    def count(frames):
        for f in frames:
            yield pd.DataFrame({"n": [len(f)]})

    out = A.two_phase(frame(spark, parts), count, "n long", lambda f: pd.DataFrame({"n": [f.n.sum()]}))
    assert [r.n for r in out.collect()] == [8]


def test_pivot_and_share(spark):
    df = spark.createDataFrame([(1, "F", 1.0), (1, "M", 3.0), (2, "F", 2.0), (None, "F", 9.0)], "y int, s string, b double")
    out = A.row_share(A.pivot(df, "y", "s", "b", "sum", ["F", "M"]), ["F", "M"]).orderBy("y").collect()
    assert [tuple(r) for r in out] == [(1, 0.25, 0.75), (2, 1.0, None)]
    assert A.pivot(df, "y", "s", "b", "mean", ["F"]).count() == 2


def test_merges(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, a string")
    right = spark.createDataFrame([(1, 10), (1, 11), (None, 12)], "k int, b int")
    assert sorted(tuple(r) for r in J.natural_merge(left, right).collect()) == [(1, "x", 10), (1, "x", 11)]
    assert sorted((tuple(r) for r in J.natural_merge(left, right, match_missing=True).collect()), key=str) == [(1, "x", 10), (1, "x", 11), (None, "z", 12)]
    assert J.broadcast_merge(left, right).count() == 2
    sized = spark.range(9).selectExpr("cast(id AS int) AS k")
    assert "BroadcastHashJoin" in plan(J.broadcast_merge(left, sized))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    assert "BroadcastHashJoin" not in plan(J.broadcast_merge(left, sized, most=0))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        J.natural_merge(left, right.withColumnRenamed("k", "q"))


def test_pairs_in_blocks(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(7)], "id long, v double")
    for block in (2, 100):
        got = {(r.ida, r.idb, r.b_v - r.a_v) for r in J.pairs(df, "id", ["v"], block).collect()}
        assert got == {(a, b, float(b - a)) for a in range(7) for b in range(7) if a != b}


def test_pairs_of_scattered_ids_in_many_tasks(spark):
    ids = [0, -7, 10**15, 3, 10**15 + 1, None, 2**62, 12, 10**9, 3]
    df = spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids)], "id long, v double").coalesce(1)
    want = sorted((a, b, x, y) for x, a in enumerate(ids) for y, b in enumerate(ids) if a is not None and b is not None and a != b)
    for block in (2, 100):
        got = J.pairs(df, "id", ["v"], block)
        assert sorted((r.ida, r.idb, r.a_v, r.b_v) for r in got.collect()) == want
    assert J.pairs(df.where("false"), "id", ["v"]).collect() == []
    many = J.pairs(spark.range(200).coalesce(1).withColumn("v", F.lit(1.0)), "id", ["v"], 20)
    assert many.rdd.getNumPartitions() > 4 and "Broadcast" not in plan(many) and many.count() == 200 * 199


def test_pairs_of_equal_values_meet_in_runs(spark):
    df = spark.range(240).selectExpr("id", "double(id % 4) AS v").repartition(3)
    got = [(r.a_v, r.b_v) for r in J.pairs(df, "id", ["v"], 60).collect()]
    assert len(got) == 240 * 239 and sum(x != y for x, y in zip(got, got[1:])) < len(got) / 20


def test_top_and_order(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i // 3)) for i in range(20)], "id long, k string, v double")
    top = K.group_top(df, ["k"], "v", 3, ["id"])
    assert {k: [r.id for r in sorted(top.collect(), key=lambda r: (-r.v, r.id)) if r.k == k] for k in "ab"} == {"a": [18, 16, 12], "b": [19, 15, 17]}
    assert "WindowGroupLimit" in plan(top)
    missing = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "id long, v double")
    assert [r.id for r in K.sort(missing, "v", ["id"]).collect()] == [3, 1, 2]
    assert [r.id for r in K.top(missing, "v", 2, ["id"]).collect()] == [1, 3]
    assert [r.id for r in K.head(missing, "v", ["id"], 1).collect()] == [3]
    assert [r.id for r in K.last_by_id(missing, "id", 2).collect()] == [3, 2]
    assert K.stack(missing, missing).count() == 6
    assert "TakeOrderedAndProject" in plan(K.top(missing, "v", 2, ["id"]))


def test_roll_as_numpy(spark):
    a = np.array([[0, 1, 2], [10, 11, 12], [20, 21, 22]], float)
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(3) for j in range(3)], "i int, j int, v double")
    for axis in (0, 1):
        for shift in (1, -1):
            want = np.roll(a, shift, axis)
            rows = df.select("i", "j", G.roll("v", shift, axis).alias("w")).collect()
            assert all(r.w == want[r.i, r.j] for r in rows)
            assert all(r.rolled == want[r.i, r.j] for r in J.shift_join(df, "v", shift, axis, 3).collect())
    with pytest.raises(ValueError):
        G.roll("v", 2, 0)
    assert [r.total for r in A.axis_sum(df, "v", 1).orderBy("i").collect()] == a.sum(1).tolist()
    assert [r.total for r in A.off_diagonal_sum(df, "v").orderBy("i").collect()] == (a.sum(1) - a.diagonal()).tolist()
    assert A.checksum(df, ["v", "v"]).first()[0] == 2 * a.sum()
    assert [r.id for r in P.flatten(df, 3).orderBy("id").collect()] == list(range(9))
    assert all(r.v == 0 for r in P.fill_diagonal(df, "v", 0.0).where("i = j").collect())
    back = P.reshape(P.flatten(df, 3).select("id", "v"), "id", 3)
    assert all(r.v == a[r.i, r.j] for r in back.collect())


def test_water_as_golden(spark):
    """One and three steps on a 4 x 4 grid."""
    run = T.states(T.still_water(spark, 4), lambda g: G.shallow_water_step(g, 4), every=100)
    states = [next(run) for _ in range(4)]
    one = states[1].where("j = 0").orderBy("i").collect()
    assert [r.v for r in one] == pytest.approx([0.001, -0.001, -0.001, 0.001]) and [r.eta for r in one] == pytest.approx([0, 0.1, 0.2, 0.3])
    three = states[3].where("j = 0").orderBy("i").collect()
    assert [r.eta for r in three] == pytest.approx([6.0e-6, 0.100003, 0.199994, 0.299997], abs=1e-9)
    assert [r.v for r in three] == pytest.approx([0.00299999, -0.00299998, -0.00299999, 0.00299998], abs=1e-8)


def test_colours():
    assert I.colour("#222b6d") == (34 / 255, 43 / 255, 109 / 255)
    assert I.colour("#fff") == (1.0, 1.0, 1.0)
    assert I.colour("rgb(20%,20%,20%)") == (0.2, 0.2, 0.2)
    for bad in ("blue", "#12", "rgb(1,2)"):
        with pytest.raises(ValueError):
            I.colour(bad)


def test_nashville_equals_its_passes(spark):
    """Carried copies give what cloning, blending and filtering step by step gives."""
    p = T.pixels(spark, 1, 6, 8)
    grey = I.negate(I.grey(p), grey_only=True)
    fill = I.colorize(p, "#222b6d", "#fff")
    step = I.blend(I.blend(p, grey, "50,50"), fill, "50,50")
    step = I.blend(I.blend(step, I.negate(grey, grey_only=True), "50,50"), fill, "50,50")
    want = I.gamma(I.modulate(step, 100.0, 150.0, 100.0), 0.7)
    key = lambda r: (r.y, r.x)
    for a, b in zip(sorted(I.nashville(p).collect(), key=key), sorted(want.collect(), key=key)):
        assert (a.r, a.g, a.b) == pytest.approx((b.r, b.g, b.b), abs=1e-9)
    tone = I.colortone(p, p, "#222b6d", "50,50", True)
    assert tone.count() == 48


def test_image_identities(spark):
    p = T.pixels(spark, 1, 5, 7)
    same = I.modulate(p, 100.0, 100.0, 100.0)
    full = I.modulate(p, 100.0, 100.0, 300.0)
    key = lambda r: (r.y, r.x)
    for other in (same, full, I.gamma(p, 1.0), I.negate(I.negate(p))):
        for a, b in zip(sorted(p.collect(), key=key), sorted(other.collect(), key=key)):
            assert (a.r, a.g, a.b) == pytest.approx((b.r, b.g, b.b), abs=1e-9)
    strips = I.strips(p, 2).groupBy("image_id", "strip").agg(F.collect_list("y").alias("s")).withColumnRenamed("strip", "y").withColumnRenamed("s", "strip")
    assert [len(x) for x in A.append_strips(strips).first().strips] == [14, 14, 7]
    assert "Exchange" not in plan(I.gotham(p)) and "Exchange" not in plan(I.nashville(p))
