"""Registry, declarations, sources, workloads' golden values, streaming, plans."""

import math
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspan.functions import declare as D
from larkspan.functions import numeric as N
from larkspan.functions import registry as X
from larkspan.operators import aggregate as A
from larkspan.operators import pictures as Q
from larkspan.operators import select as P
from larkspan.plans import catalogue
from larkspan.plans import workloads as W
from larkspan.sources import tables as T
from larkspan.streaming import events as E

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registration_is_checked(spark):
    with pytest.raises(ValueError):
        X.splittable((X.ROWS,), schema="double")(lambda a, b: a)
    with pytest.raises(ValueError):
        X.splittable((X.ROWS, X.ROWS), schema="double")(lambda a: a)
    with pytest.raises(ValueError):
        X.splittable(("slices",), schema="double")(lambda a: a)
    with pytest.raises(ValueError):
        X.splittable((X.ROWS,))(lambda a: a)
    f = X.splittable((X.ROWS,), schema="double")(lambda a, k=2: a * k)
    assert f.args == (X.ROWS, X.WHOLE) and f(3, 4) == 12
    with pytest.raises(TypeError):
        f.column(F.lit(1), 2, 3)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_native_and_batched_forms_agree(spark, parts):
    twice = X.splittable((X.ROWS, X.WHOLE), schema="double", native=lambda c, k: c * k)(lambda a, k: a * k)
    df = spark.range(100).select("id", (F.col("id") / 7).alias("v")).repartition(parts)
    out = df.select(twice(F.col("v"), 3.0).alias("n"), twice.column(F.col("v"), 3.0, native=False).alias("p"))
    assert all(r.n == pytest.approx(r.p) for r in out.collect())
    assert "ArrowEvalPython" not in plan(df.select(twice(F.col("v"), 3.0)))


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_results_do_not_depend_on_partitions(spark, parts):
    df = spark.range(50).select(F.col("id").cast("double").alias("l_extendedprice"), (F.col("id") % 3).cast("string").alias("mode")).repartition(parts)
    assert catalogue.total_of.reduce(df, "l_extendedprice").first()[0] == 1225.0
    assert sorted(r[0] for r in catalogue.values_of.reduce(df, "mode").collect()) == ["0", "1", "2"]
    assert catalogue.most_of.merge(df.select("l_extendedprice")).collect() == [(49.0,)]


def test_kinds_of_arguments():
    assert D.parse_kind("Rows()") == D.Kind("Rows")
    assert D.parse_kind(" Cells ( height ,width ) ") == D.Kind("Cells", ("height", "width"))
    assert D.parse_kind("broadcast").form == "broadcast" and D.parse_kind("Q").form == "generic"
    assert D.parse_param("   price:    Rows(count)   ") == ("price", D.Kind("Rows", ("count",)))
    for bad in ("price:: Rows(count)", "price Rows(count)", "price: Rows(count", "price: rows"):
        with pytest.raises(ValueError):
            D.parse_param(bad)


@pytest.mark.parametrize("text,want", [("long", "long"), ("char*", "char *"), ("const float", "const float"), ("double  *", "double *"), ("struct body", "struct body"), ("const union cell *", "const union cell *"), ("long***", "long ***")])
def test_c_types(text, want):
    assert D.parse_type(text) == want


def test_declarations():
    assert D.parse_declaration("long tick();") == D.Declaration("long", "tick", ())
    d = D.parse_declaration("void move(float, struct body **bodies, long *);")
    assert d.params == (("float", None), ("struct body **", "bodies"), ("long *", None))
    text = "@split (n: Size(), a: Rows(n), b: broadcast) -> Rows(n) default b: 1.5 { double *scale(long n, const double *a, double b); } // done"
    (a,) = D.parse(text)
    assert a.positions() == {"n": 0, "a": 1, "b": 2} and a.defaults == (("b", "1.5"),) and a.functions[0].name == "scale"
    for bad in (text.replace("-> Rows(n) ", ""), text.replace("Rows(n),", "Rows(q),"), text.replace(", double b", ""), text.replace("}", "")):
        with pytest.raises(ValueError):
            D.parse(bad)


SCALE = "@split (a: V, b: V, k: broadcast) -> V default k: 3 { double scaled_sum(const double *a, const double *b, double k); }"


scaled_sum = lambda a, b, k: (a + b) * k  # noqa: E731  (a lambda, so that it goes to the workers by value)


def test_declarations_register_functions(spark):
    f = D.register(SCALE, {"scaled_sum": scaled_sum})["scaled_sum"]
    assert f.args == (X.ROWS, X.ROWS, X.WHOLE) and f.schema == "double" and X.REGISTRY["scaled_sum"] is f
    assert f(1, 2) == 9 and f(1, 2, k=1) == 3
    df = spark.range(4).select(F.col("id").cast("double").alias("v"))
    assert sorted(r[0] for r in df.select(f(F.col("v"), F.col("v"), 2.0)).collect()) == [0.0, 4.0, 8.0, 12.0]
    assert D.meanings(D.parse(SCALE)[0], {"V": X.WHOLE}) == ((X.WHOLE, X.WHOLE, X.WHOLE), X.WHOLE)
    with pytest.raises(ValueError):
        D.register(SCALE, {})
    with pytest.raises(ValueError):
        D.register(SCALE.replace("a: V", "a: Unknown()"), {"scaled_sum": scaled_sum})
    with pytest.raises(ValueError):
        D.register(SCALE.replace("double scaled_sum", "struct pair scaled_sum"), {"scaled_sum": scaled_sum})


def test_declarations_from_the_command_line(tmp_path, capsys, monkeypatch):
    (tmp_path / "scale.txt").write_text(SCALE)
    (tmp_path / "plain_sums.py").write_text("def scaled_sum(a, b, k):\n    return (a + b) * k\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert D.main([str(tmp_path / "scale.txt"), "-m", "plain_sums", "-p", "my_", "-o", str(tmp_path / "wrapped_sums.py"), "-d"]) == 0
    assert "scaled_sum" in capsys.readouterr().err
    import wrapped_sums

    assert wrapped_sums.my_scaled_sum(1, 1) == 6
    assert D.main([str(tmp_path / "scale.txt"), "-m", "plain_sums"]) == 0 and "DECLARATIONS" in capsys.readouterr().out
    (tmp_path / "bad.txt").write_text("@split (a: V { }")
    assert D.main([str(tmp_path / "bad.txt")]) == 1


def test_erf_is_exact(spark):
    values = [k / 37 for k in range(-260, 261)] + [0.46875, 4.0, -0.0, 30.0, float("inf"), float("nan")]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "x double").select("x", N.erf("x").alias("e")).collect()
    assert all(r.e is None if r.x is None else math.isnan(r.e) if math.isnan(r.x) else abs(r.e - math.erf(r.x)) < 4e-16 for r in rows)


def test_pictures():
    rnd = np.random.default_rng(3)
    grid = rnd.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    content = Q.encode_png(grid)
    assert (Q.decode_png(content) == grid).all()

    def filtered(pixels, kinds):
        """A file whose lines are filtered as kinds say, by the definition of each filter."""
        h, w, c = pixels.shape
        flat, lines = pixels.reshape(h, w * c).astype(int), b""
        at = lambda y, x: int(flat[y, x]) if y >= 0 and x >= 0 else 0
        for y, kind in enumerate(kinds):
            line = []
            for x in range(w * c):
                a, b, d = at(y, x - c), at(y - 1, x), at(y - 1, x - c)
                p = a + b - d
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
                line.append((at(y, x) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
            lines += bytes([kind, *line])
        part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
        return Q.SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")

    assert (Q.decode_png(filtered(grid, range(5))) == grid).all()
    four = rnd.integers(0, 256, (5, 4, 4)).astype(np.uint8)
    assert (Q.decode_png(filtered(four, (4, 3, 2, 1, 0))) == four[:, :, :3]).all()
    assert (Q.decode_png(filtered(grid[:, :, :1], (1, 4, 3, 2, 0))) == grid[:, :, :1]).all()
    for bad in (b"II*", content[:40] + b"x" + content[41:]):
        with pytest.raises(ValueError):
            Q.decode_png(bad)


def test_partials_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(A, "FAN_IN", 3)
    df = spark.range(500).select(F.col("id").cast("double").alias("l_extendedprice")).repartition(20)
    assert catalogue.most_of.merge(df).collect() == [(499.0,)]


def test_shared_folders_are_named_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        T.scratch(Cluster)


def test_readers(spark, tmp_path):
    (tmp_path / "m.dat").write_text("1::Toy Story (1995)::Animation|Comedy\n2::Jumanji::Adventure\n")
    rows = T.read_csv(spark, str(tmp_path / "m.dat"), "movie_id int, title string, genres string", sep="::").orderBy("movie_id").collect()
    assert [tuple(r) for r in rows] == [(1, "Toy Story (1995)", "Animation|Comedy"), (2, "Jumanji", "Adventure")]
    (tmp_path / "n.csv").write_text("1880,F,Mary,7065\n")
    assert T.read_csv(spark, str(tmp_path / "n.csv"), "year int, sex string, name string, births bigint").first().births == 7065
    (tmp_path / "x.tif").write_bytes(b"II*\0")
    assert bytes(T.read_images(spark, str(tmp_path / "x.tif")).first().content) == b"II*\0"
    T.save(spark.range(3), str(tmp_path / "out"))
    assert T.to_pandas(T.read_parquet(spark, str(tmp_path / "out"))).id.sum() == 3
    assert T.from_pandas(spark, pd.DataFrame({"a": [1, 2]}), "a int").count() == 2
    with pytest.raises(NotImplementedError):
        T.ones(spark, 2, 2, 2)


def test_replication_keeps_one_row_once(spark):
    df = spark.range(5)
    assert T.replicate(df, 3, once="id = 0").count() == 5 * 3 - 2


@pytest.mark.parametrize("log,erf", [("log2", "exact"), ("log2", "fast")])
def test_black_scholes_golden(spark, log, erf):
    df = spark.createDataFrame([(4.0,) * 5, (100.0, 110.0, 0.5, 0.03, 0.2)], "price double, strike double, t double, rate double, vol double")
    a, b = sorted(W.black_scholes(df, log, erf).collect(), key=lambda r: r.price)
    near = lambda v: pytest.approx(v, rel=1e-9 if erf == "exact" else 1e-4)
    assert (a.call, a.put) == (near(23.999997299155808), near(17.999997974366856))
    assert (b.call, b.put) == (near(15.624905068017796), near(28.168375102523147))


def test_haversine_golden(spark):
    p = F.lit(0.0698132)
    row = spark.range(1).select(W.haversine(p, p).alias("a"), W.haversine(p, p, lon1=-W.LON).alias("b")).first()
    assert (row.a, row.b) == (pytest.approx(4839.959830633562), pytest.approx(5253.221630044594))


def test_crime_golden(spark):
    rows = [(5e5, 2.5e5, 1000.0), (4e5, 1e5, 298.9), (5e5, 1e5, 349.0), (6e5, 1e5, 99.2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, total_population double, adult_population double, num_robberies double")
    got = lambda inclusive: [r.crime_index for r in W.crime_index(df, inclusive).orderBy("id").collect()]
    assert got(False) == pytest.approx([0.005, 0.032, 0.02, 0.016]) and got(True) == pytest.approx([0.005, 0.032, 0.005, 0.016])


def test_cleaning_golden(spark):
    df = spark.createDataFrame([("00000-1",), ("94305",), ("94305-2",), (None,)], "z string")
    assert {r.z for r in W.clean_zips(df, "z").collect()} == {"94305", None}
    assert [r.z for r in W.clean_zips(T.constant(spark, 50, z="1234567"), "z").collect()] == ["12345"]


@pytest.mark.parametrize("steps,total", [(1, -141910485218610.5), (3, -141910411311402.28)])
def test_nbody_golden(spark, steps, total):
    run = T.states(T.galaxy(spark, 4), W.nbody_step, every=2)
    states = [next(run) for _ in range(steps + 1)]
    out = states[-1].orderBy("id").collect()
    assert sum(r.x + r.y + r.z for r in out) == pytest.approx(total, rel=1e-8)
    if steps == 1:
        assert [r.vx for r in out] == pytest.approx([2.0277055, 0.4593864, -0.2882424, -2.0427182], rel=1e-6)


def test_tagging(spark):
    df = spark.createDataFrame([(1, "The dog barked. In Paris it was 3 days."), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.tagged for r in W.tag_texts(df).collect()}
    assert rows[1] == "the|DT dog|NN barked|VBD .|. in|IN Paris|NNP it|PRP was|VBD 3|CD days|NNS .|." and rows[2] == ""


def test_plans_push_down(spark):
    p = plan(catalogue.QUERIES["filter_gt"](spark, SMALL))
    assert "GreaterThan(l_quantity,45.0)" in p and "l_extendedprice" not in p
    for name in ("arith_chain", "black_scholes", "haversine", "crime_index", "gotham", "nashville"):
        text = plan(catalogue.QUERIES[name](spark, SMALL))
        assert "Python" not in text and "Exchange" not in text, name
    assert "Python" not in plan(catalogue.QUERIES["text_tag"](spark, SMALL))
    assert plan(catalogue.QUERIES["rating_gap"](spark, SMALL)).count("CartesianProduct") == 0


def test_streamed_windows_equal_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = E.windowed_counts(E.read_events(spark, str(tmp_path / "in")), late="1 hour").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    try:
        q.processAllAvailable()
        got = {(r.window_start, r.event_type): r.n for r in spark.table("windows").collect()}
    finally:
        q.stop()
    assert got == {(r.window_start, r.event_type): r.n for r in E.windowed_counts(events).collect()}


def test_small_inputs_are_spread(spark):
    few = spark.read.parquet(f"{SMALL}/orders.parquet")
    assert T.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "Exchange" not in plan(T.spread(spark.createDataFrame([(1,)], "a int")))


def test_derived_and_shown(spark, capsys):
    T.show_head(P.derive(spark.range(2), "d", F.col("id") + 1))
    assert "|0  |1  |" in capsys.readouterr().out
    assert math.isclose(T.zeros(spark, 4).agg(F.sum("v")).first()[0], 0.0)
