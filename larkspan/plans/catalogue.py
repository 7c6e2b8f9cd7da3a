"""The registered queries of the library and their SQL for DuckDB.

Doubles are rounded on both sides, since the order of a sum is not fixed.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import declare as D
from ..functions import numeric as N
from ..functions import registry as X
from ..functions import strings as S
from ..operators import aggregate as A
from ..operators import grid as G
from ..operators import images as I
from ..operators import joins as J
from ..operators import pictures as Q
from ..operators import select as P
from ..operators import topk as K
from ..sources import tables as T
from ..streaming import events as E
from . import workloads as W

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 6):
    """Rounded, with -0.0 as 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# Selection


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def filter_gt(spark, d):
    return P.filter_greater(read(spark, d, "lineitem"), "l_quantity", 45.0).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN 0.0::DOUBLE ELSE l_discount END AS masked FROM lineitem")
def mask_ge(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.mask(F.col("l_discount"), N.greater_equal("l_discount", 0.05), 0.0).alias("masked"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax < 0.02")
def cmp_lt(spark, d):
    return P.where_mask(read(spark, d, "lineitem"), N.less("l_tax", 0.02)).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 7")
def cmp_eq(spark, d):
    return P.where_mask(read(spark, d, "lineitem"), N.equal("l_quantity", 7.0)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, NOT (o_totalprice > 150000) AS small FROM orders")
def not_mask(spark, d):
    return read(spark, d, "orders").select("o_orderkey", P.negate(N.greater("o_totalprice", 150000.0)).alias("small"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def isin_semi(spark, d):
    wanted = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return P.is_in(read(spark, d, "orders"), "o_custkey", wanted).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def isin_list(spark, d):
    return P.is_in(read(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def loc_having(spark, d):
    orders = read(spark, d, "orders")
    return P.label_rows(orders, "o_custkey", P.having(orders, ["o_custkey"], 12)).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, count(*)::BIGINT AS size FROM orders GROUP BY 1 HAVING count(*) >= 12")
def having_size(spark, d):
    return P.having(read(spark, d, "orders"), ["o_custkey"], 12)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_extendedprice * l_discount, 6) AS diff FROM lineitem")
def derived_column(spark, d):
    out = P.derive(read(spark, d, "lineitem"), "diff", N.subtract("l_extendedprice", N.multiply("l_extendedprice", F.col("l_discount"))))
    return out.select("l_orderkey", "l_linenumber", r("diff").alias("diff"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey >= 100 AND p_partkey < 150")
def position_slice(spark, d):
    return P.positions(read(spark, d, "part"), "p_partkey", 100, 150).select("p_partkey", "p_name")


@query("SELECT count(*)::BIGINT AS n FROM orders")
def frame_length(spark, d):
    return read(spark, d, "orders").agg(F.count("*").alias("n"))


GRID_SIDE = 10


def part_grid(spark, d):
    """p_retailprice as a matrix of GRID_SIDE columns, by its gapless key from 0."""
    flat = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))
    return P.reshape(flat, "id", GRID_SIDE)


GRID_SQL = "g AS (SELECT (p_partkey // 10)::INTEGER AS i, (p_partkey % 10)::INTEGER AS j, p_retailprice AS v FROM part)"


@query(f"WITH {GRID_SQL} SELECT i, j, v FROM g")
def reshape_grid(spark, d):
    return part_grid(spark, d).select("i", "j", "v")


@query("SELECT p_partkey AS id, p_retailprice AS v FROM part")
def flatten_grid(spark, d):
    return P.flatten(part_grid(spark, d), GRID_SIDE).select("id", "v")


@query(f"WITH {GRID_SQL} SELECT i, j, CASE WHEN i = j THEN 0.0::DOUBLE ELSE v END AS v FROM g")
def fill_diagonal(spark, d):
    return P.fill_diagonal(part_grid(spark, d), "v", 0.0).select("i", "j", "v")


# Joins


@query("SELECT n_regionkey AS regionkey, n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def natural_merge(spark, d):
    nation = read(spark, d, "nation").withColumnRenamed("n_regionkey", "regionkey")
    return J.natural_merge(nation, read(spark, d, "region").withColumnRenamed("r_regionkey", "regionkey"))


@query("SELECT l_orderkey AS orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def chain_merge(spark, d):
    items = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber")
    return J.chain_merge(items, read(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_custkey"))


@query("SELECT c_nationkey AS nationkey, c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def broadcast_merge(spark, d):
    customers = read(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), "c_custkey")
    return J.broadcast_merge(customers, read(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name"))


@query(
    """WITH k AS (SELECT DISTINCT CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END AS p FROM orders),
    l AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END AS p FROM orders)
    SELECT l.p, o_orderkey FROM l JOIN k ON l.p IS NOT DISTINCT FROM k.p"""
)
def merge_missing_keys(spark, d):
    p = F.when(~F.col("o_orderpriority").like("5%"), F.col("o_orderpriority")).alias("p")
    left = read(spark, d, "orders").select("o_orderkey", p)
    return J.natural_merge(left, read(spark, d, "orders").select(p).distinct(), match_missing=True).select("p", "o_orderkey")


@query("SELECT a.s_suppkey AS ida, b.s_suppkey AS idb, round(b.s_acctbal - a.s_acctbal, 6) + 0.0 AS delta, round(a.s_acctbal * b.s_acctbal, 6) + 0.0 AS product FROM supplier a, supplier b WHERE a.s_suppkey <> b.s_suppkey")
def cross_pairs(spark, d):
    p = J.pairs(read(spark, d, "supplier"), "s_suppkey", ["s_acctbal"])
    delta, product = F.col("b_s_acctbal") - F.col("a_s_acctbal"), F.col("a_s_acctbal") * F.col("b_s_acctbal")
    return p.select("ida", "idb", (N.rounded(delta, 6) + 0.0).alias("delta"), (N.rounded(product, 6) + 0.0).alias("product"))


def _roll_sql(shift: int, axis: int) -> str:
    side = "(SELECT max(i) + 1 FROM g)" if axis == 0 else "10"
    moved = "i" if axis == 0 else "j"
    other = "j" if axis == 0 else "i"
    return f"WITH {GRID_SQL} SELECT a.i, a.j, b.v AS rolled FROM g a JOIN g b ON a.{other} = b.{other} AND a.{moved} = (b.{moved} + {shift} + {side}) % {side}"


def _roll(shift: int, axis: int):
    def run(spark, d):
        return part_grid(spark, d).select("i", "j", G.roll("v", shift, axis).alias("rolled"))

    run.__name__ = f"roll_axis{axis}_{'back' if shift < 0 else 'ahead'}"
    return query(_roll_sql(shift, axis))(run)


for _axis in (0, 1):
    for _shift in (-1, 1):
        _roll(_shift, _axis)


@query(f"WITH {GRID_SQL} SELECT a.i, a.j, a.v, b.v AS rolled FROM g a JOIN g b ON a.i = b.i AND a.j = (b.j + 1) % 10")
def shift_join(spark, d):
    return J.shift_join(part_grid(spark, d), "v", 1, 1, GRID_SIDE)


@query(f"WITH {GRID_SQL} SELECT a.i, a.j, round((n.v - p.v) / 0.2, 6) + 0.0 AS slope FROM g a JOIN g n ON a.i = n.i AND n.j = (a.j + 1) % 10 JOIN g p ON a.i = p.i AND p.j = (a.j + 9) % 10")
def central_difference(spark, d):
    return part_grid(spark, d).select("i", "j", r(G.central_difference("v", 1, 0.1)).alias("slope"))


# Aggregation


@query("SELECT l_returnflag, round(sum(CASE WHEN l_quantity < 25 THEN l_extendedprice END), 2) AS total FROM lineitem GROUP BY 1")
def nan_sum(spark, d):
    holes = F.when(F.col("l_quantity") < 25, F.col("l_extendedprice")).otherwise(F.lit(float("nan")))
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(r(A.nan_sum(holes), 2).alias("total"))


@query("SELECT round(sum(o_totalprice), 2) AS total FROM orders")
def series_sum(spark, d):
    return read(spark, d, "orders").agg(r(A.nan_sum("o_totalprice"), 2).alias("total"))


@query("SELECT DISTINCT CASE WHEN substr(o_orderpriority, 1, 5) = '1-URG' THEN NULL ELSE substr(o_orderpriority, 1, 5) END AS zip FROM orders")
def distinct_zip(spark, d):
    return W.clean_zips(read(spark, d, "orders").select(F.col("o_orderpriority").alias("zip")), "zip", 5, "1-URG")


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS size FROM lineitem GROUP BY ALL")
def group_size(spark, d):
    return A.group_size(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS std FROM lineitem GROUP BY 1")
def group_std(spark, d):
    return A.group_std(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", r("std").alias("std"))


def _mode_row(frame: pd.DataFrame) -> pd.DataFrame:
    top = frame.sort_values(["l_extendedprice", "l_orderkey", "l_linenumber"], ascending=[False, True, True])[:3]
    return top[["l_linestatus", "l_shipmonth", "l_orderkey", "l_linenumber"]]


@query("SELECT l_linestatus, l_shipmonth, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus, l_shipmonth ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM (SELECT *, (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS l_shipmonth FROM lineitem)) WHERE k <= 3")
def group_apply(spark, d):
    items = read(spark, d, "lineitem").withColumn("l_shipmonth", (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long"))
    return A.group_apply(items.select("l_linestatus", "l_shipmonth", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_linestatus", "l_shipmonth"], _mode_row, "l_linestatus string, l_shipmonth long, l_orderkey long, l_linenumber int")


YEAR_SUM = "SELECT year(o_orderdate)::BIGINT AS year, {} FROM orders GROUP BY 1"


def _orders_by_year(spark, d):
    return read(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus", "o_totalprice")


@query(YEAR_SUM.format(", ".join(f"round(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 2) AS {s}" for s in "FOP")))
def pivot_sum(spark, d):
    out = A.pivot(_orders_by_year(spark, d), "year", "o_orderstatus", "o_totalprice", "sum", ["F", "O", "P"])
    return out.select("year", *[r(c, 2).alias(c) for c in "FOP"])


@query(YEAR_SUM.format(", ".join(f"round(avg(o_totalprice) FILTER (o_orderstatus = '{s}'), 6) AS {s}" for s in "FOP")))
def pivot_mean(spark, d):
    out = A.pivot(_orders_by_year(spark, d), "year", "o_orderstatus", "o_totalprice", "mean", ["F", "O", "P"])
    return out.select("year", *[r(c).alias(c) for c in "FOP"])


@query(YEAR_SUM.format(", ".join(f"round(sum(o_totalprice) FILTER (o_orderstatus = '{s}') / sum(o_totalprice), 6) AS {s}" for s in "FOP")))
def row_share(spark, d):
    out = A.row_share(A.pivot(_orders_by_year(spark, d), "year", "o_orderstatus", "o_totalprice", "sum", ["F", "O", "P"]), ["F", "O", "P"])
    return out.select("year", *[r(c).alias(c) for c in "FOP"])


@query(f"WITH {GRID_SQL} SELECT i, round(sum(v), 4) AS total FROM g GROUP BY 1")
def axis_reduce_rows(spark, d):
    return A.axis_sum(part_grid(spark, d), "v", 1).select("i", r("total", 4).alias("total"))


@query(f"WITH {GRID_SQL} SELECT j, round(sum(v), 4) AS total FROM g GROUP BY 1")
def axis_reduce_columns(spark, d):
    return A.axis_sum(part_grid(spark, d), "v", 0).select("j", r("total", 4).alias("total"))


@query(f"WITH {GRID_SQL} SELECT i, round(sum(v), 4) AS total FROM g WHERE i <> j GROUP BY 1")
def offdiag_sum(spark, d):
    return A.off_diagonal_sum(part_grid(spark, d), "v").select("i", r("total", 4).alias("total"))


@query("SELECT round(sum(l_quantity + l_discount + l_tax), 4) AS checksum FROM lineitem")
def checksum(spark, d):
    return A.checksum(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).select(r("checksum", 4).alias("checksum"))


def _flag_partial(frames):
    for f in frames:
        yield f.groupby("l_returnflag", as_index=False).agg(n=("l_quantity", "size"), low=("l_quantity", "min"))


def _flag_combine(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.groupby("l_returnflag", as_index=False).agg(n=("n", "sum"), low=("low", "min"))


@query("SELECT l_returnflag, count(*)::BIGINT AS n, min(l_quantity) AS low FROM lineitem GROUP BY 1")
def two_phase_aggregate(spark, d):
    items = read(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    return A.two_phase(items, _flag_partial, "l_returnflag string, n long, low double", _flag_combine, ["l_returnflag"])


@query("SELECT i.o_custkey AS image_id, list(i.o_orderkey ORDER BY i.o_orderkey) AS strips FROM orders i GROUP BY 1")
def ordered_append(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("y"), F.col("o_orderkey").alias("strip"))
    return A.append_strips(o)


# Order, limit, sets


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 100")
def group_topk(spark, d):
    return K.group_top(read(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", 100, ["l_orderkey", "l_linenumber"])


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey")
def full_sort(spark, d):
    return K.sort(read(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", ["p_partkey"])


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 5")
def sort_head(spark, d):
    return K.head(read(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", ["p_partkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_desc(spark, d):
    return K.top(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10, ["o_orderkey"])


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id DESC LIMIT 100")
def last_rows(spark, d):
    return K.last_by_id(read(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100)


@query("SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_frames(spark, d):
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    return K.stack(c.selectExpr("c_custkey AS key", "c_name AS name"), s.selectExpr("s_suppkey AS key", "s_name AS name"))


# Numeric functions


@query("SELECT l_orderkey, l_linenumber, round((l_quantity + l_tax - 0.5) * 3 / (1 + l_discount), 6) AS a, round(1.0::DOUBLE - l_discount, 6) AS b, round(100.0::DOUBLE / l_quantity, 6) AS c FROM lineitem")
def arith_chain(spark, d):
    out = N.divide(N.multiply(N.subtract(N.add("l_quantity", "l_tax"), 0.5), 3.0), N.add(1.0, "l_discount"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(out).alias("a"), r(N.subtract(1.0, "l_discount")).alias("b"), r(N.divide(100.0, "l_quantity")).alias("c"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN CASE WHEN l_quantity = 25 THEN 0.0::DOUBLE ELSE round((l_quantity - 25) / l_discount, 6) END
    WHEN l_quantity > 25 THEN 'inf'::DOUBLE WHEN l_quantity < 25 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS q FROM lineitem"""
)
def divide_by_zero(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(N.divide(F.col("l_quantity") - 25, F.col("l_discount"))).alias("q"))


@query(
    """SELECT l_orderkey, l_linenumber, round(pow(l_quantity, 1.5), 6) AS p, round(exp(-l_tax), 6) AS e, round(sqrt(l_quantity), 6) AS s,
    CASE WHEN l_discount = 0 THEN '-inf'::DOUBLE ELSE round(ln(l_discount), 6) END AS l, CASE WHEN l_tax = 0 THEN '-inf'::DOUBLE ELSE round(log2(l_tax), 6) END AS l2, round(ln(1 + l_discount), 6) + 0.0 AS l1p FROM lineitem"""
)
def pow_log_exp(spark, d):
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r(N.power("l_quantity", 1.5)).alias("p"), r(N.exp(-F.col("l_tax"))).alias("e"), r(N.sqrt("l_quantity")).alias("s"), r(N.log("l_discount")).alias("l"), r(N.log2("l_tax")).alias("l2"), r(N.log1p("l_discount")).alias("l1p")
    )


@query("SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 6) + 0.0 AS s, round(cos(l_quantity), 6) + 0.0 AS c, round(asin(l_discount), 6) AS a, abs(l_quantity - 25) AS d, ((l_orderkey - 7) % 5 + 5) % 5 AS m FROM lineitem")
def trig(spark, d):
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r(N.sin("l_quantity")).alias("s"), r(N.cos("l_quantity")).alias("c"), r(N.arcsin("l_discount")).alias("a"), N.absolute(F.col("l_quantity") - 25).alias("d"), N.modulus(F.col("l_orderkey") - 7, 5).cast("long").alias("m")
    )


def _erf_sql(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * abs({x})))"
    poly = f"((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t}"
    y = f"(1.0::DOUBLE - {poly} * exp(-({x}) * ({x})))"
    return f"(CASE WHEN {x} < 0 THEN -{y} ELSE {y} END)"


@query(f"SELECT l_orderkey, l_linenumber, round({_erf_sql('(l_quantity - 25) / 20')}, 6) + 0.0 AS e FROM lineitem")
def erf_fast(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(N.erf((F.col("l_quantity") - 25) / 20, "fast")).alias("e"))


def _erf_exact_sql(x: str) -> str:
    def ratio(parts, v):
        def value(terms):
            out = f"{terms[0]!r}::DOUBLE"
            for t in terms[1:]:
                out = f"({out} * {v} + {t!r}::DOUBLE)"
            return out

        return f"({value(parts[0])} / {value(parts[1])})"

    a = f"abs({x})"
    z = f"(1.0::DOUBLE / ({a} * {a}))"
    far = f"(CASE WHEN {a} <= {N.ERF_MIDDLE_END!r}::DOUBLE THEN 1.0::DOUBLE - exp(-{a} * {a}) * {ratio(N.ERF_MIDDLE, a)} ELSE 1.0::DOUBLE - exp(-{a} * {a}) / {a} * ({1 / N.ROOT_OF_PI!r}::DOUBLE - {z} * {ratio(N.ERF_TAIL, z)}) END)"
    return f"(CASE WHEN {a} <= {N.ERF_CENTRE_END!r}::DOUBLE THEN {x} * {ratio(N.ERF_CENTRE, f'({x} * {x})')} WHEN {x} < 0 THEN -{far} ELSE {far} END)"


@query(f"SELECT l_orderkey, l_linenumber, round({_erf_exact_sql('((l_quantity - 25) / 20)')}, 6) + 0.0 AS e FROM lineitem")
def erf_exact(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(N.erf((F.col("l_quantity") - 25) / 20)).alias("e"))


# Strings


@query("SELECT p_partkey, substr(p_name, 3, 4) AS part, lower(p_brand) AS low, regexp_matches(p_type, 'B.*S') AS hit, p_brand = 'Brand#13' AS same FROM part")
def string_functions(spark, d):
    return read(spark, d, "part").select("p_partkey", S.slice_text(F.col("p_name"), 2, 6).alias("part"), S.lower(F.col("p_brand")).alias("low"), S.contains(F.col("p_type"), "B.*S").alias("hit"), S.same(F.col("p_brand"), "Brand#13").alias("same"))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '(\.\.\.|[\p{L}\p{M}\p{N}_''-]+|[^\s\p{L}\p{M}\p{N}_''-])') AS w FROM documents)
    SELECT doc_id, len(w)::INTEGER AS n_tokens, len(list_filter(w, lambda x: regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '(^|\P{L})\p{Ll}|\p{L}\p{Lu}')))::INTEGER AS titled,
    ((len(w) > 0)::INTEGER + len(list_filter(w[2:-2], lambda x: x IN ('.', '!', '?', '...'))))::INTEGER AS begins FROM t"""
)
def sentence_tokens(spark, d):
    docs = read(spark, d, "documents").select("doc_id", S.without_space(S.tokens(F.col("text"))).alias("w"))
    titled = F.size(F.filter("w", lambda t: S.is_title(t))).alias("titled")
    begins = F.size(F.filter(S.sentence_begins(F.col("w")), lambda b: b)).alias("begins")
    return docs.select("doc_id", F.size("w").alias("n_tokens"), titled, begins)


# Images


HEIGHT, WIDTH = 48, 64
#: Images and grids grow with the part table: an image for each 64 parts, and grids of about as many cells as parts.
PIXEL_SQL = f"""ids AS (SELECT unnest(range({HEIGHT * WIDTH} * ((count(*) + 63) // 64))) AS id FROM part),
  p AS (SELECT (id // {HEIGHT * WIDTH})::INTEGER AS image_id, (id // {WIDTH} % {HEIGHT})::INTEGER AS y, (id % {WIDTH})::INTEGER AS x,
  ((id % {WIDTH}) * 7 + id // {HEIGHT * WIDTH}) % 256 / 255.0::DOUBLE AS r, ((id // {WIDTH} % {HEIGHT}) * 5 + id % {WIDTH}) % 256 / 255.0::DOUBLE AS g, ((id % {WIDTH}) + (id // {WIDTH} % {HEIGHT}) * 3) % 256 / 255.0::DOUBLE AS b FROM ids)"""
CLOSE = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in "rgb")


def _pixels(spark, d):
    return T.pixels(spark, -(-read(spark, d, "part").count() // 64), HEIGHT, WIDTH)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("image_id", "y", "x", *[r(c).alias(c) for c in "rgb"])


@query(f"WITH {PIXEL_SQL} SELECT image_id, y, x, {CLOSE} FROM p")
def image_pixels(spark, d):
    return _shown(_pixels(spark, d))


def _fill_sql(source: str, target: str) -> str:
    return f"{target} AS (SELECT image_id, y, x, r * 0.8::DOUBLE + 34 / 255.0::DOUBLE * 0.2::DOUBLE AS r, g * 0.8::DOUBLE + 43 / 255.0::DOUBLE * 0.2::DOUBLE AS g, b * 0.8::DOUBLE + 109 / 255.0::DOUBLE * 0.2::DOUBLE AS b FROM {source})"


@query(f"WITH {PIXEL_SQL}, {_fill_sql('p', 'q')} SELECT image_id, y, x, {CLOSE} FROM q")
def image_colorize(spark, d):
    return _shown(I.colorize(_pixels(spark, d), "#222b6d", "rgb(20%,20%,20%)"))


GREY_SQL = "0.212656::DOUBLE * r + 0.715158::DOUBLE * g + 0.072186::DOUBLE * b"


@query(f"WITH {PIXEL_SQL}, q AS (SELECT image_id, y, x, 1.0 - ({GREY_SQL}) AS r, 1.0 - ({GREY_SQL}) AS g, 1.0 - ({GREY_SQL}) AS b FROM p) SELECT image_id, y, x, {CLOSE} FROM q")
def image_grey_negate(spark, d):
    return _shown(I.negate(I.grey(_pixels(spark, d)), grey_only=True))


def _contrast_sql(source: str, target: str) -> str:
    m = "greatest(r, g, b)"
    new = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {m} + 0.5 * (0.5 * (sin(pi() * ({m} - 0.5)) + 1) - {m})))"
    return f"{target} AS (SELECT image_id, y, x, " + ", ".join(f"CASE WHEN {m} > 0 THEN {c} * {new} / {m} ELSE {new} END AS {c}" for c in "rgb") + f" FROM {source})"


def _gamma_sql(source: str, target: str, value: float) -> str:
    return f"{target} AS (SELECT image_id, y, x, " + ", ".join(f"pow(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {c})), {1 / value!r}::DOUBLE) AS {c}" for c in "rgb") + f" FROM {source})"


def _modulate_sql(source: str, target: str, light: float, sat: float) -> str:
    """Hue unturned."""
    return f"""{target}_1 AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM {source}),
    {target}_2 AS (SELECT *, (hi + lo) / 2 AS l, hi - lo AS d FROM {target}_1),
    {target}_3 AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN l <= 0.5 THEN d / (hi + lo) ELSE d / (2.0::DOUBLE - hi - lo) END AS s,
      CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN hi = r THEN (g - b) / d / 6.0::DOUBLE WHEN hi = g THEN (b - r) / d / 6.0::DOUBLE + 1.0::DOUBLE / 3 ELSE (r - g) / d / 6.0::DOUBLE + 2.0::DOUBLE / 3 END AS h FROM {target}_2),
    {target}_4 AS (SELECT image_id, y, x, h, least(1.0::DOUBLE, l * {light / 100!r}::DOUBLE) AS l, least(1.0::DOUBLE, s * {sat / 100!r}::DOUBLE) AS s FROM {target}_3),
    {target}_5 AS (SELECT *, CASE WHEN l <= 0.5 THEN l * (1 + s) ELSE l + s - l * s END AS q FROM {target}_4),
    {target}_6 AS (SELECT image_id, y, x, q, 2 * l - q AS p, h + 1.0::DOUBLE / 3 - floor(h + 1.0::DOUBLE / 3) AS tr, h - floor(h) AS tg, h - 1.0::DOUBLE / 3 - floor(h - 1.0::DOUBLE / 3) AS tb FROM {target}_5),
    {target} AS (SELECT image_id, y, x, """ + ", ".join(f"CASE WHEN t{c} * 6 < 1 THEN p + (q - p) * 6 * t{c} WHEN t{c} * 2 < 1 THEN q WHEN t{c} * 3 < 2 THEN p + (q - p) * (2.0::DOUBLE / 3 - t{c}) * 6 ELSE p END AS {c}" for c in "rgb") + f" FROM {target}_6)"  # fmt: skip


@query(f"WITH {PIXEL_SQL}, {_contrast_sql('p', 'q')} SELECT image_id, y, x, {CLOSE} FROM q")
def image_contrast(spark, d):
    return _shown(I.contrast(_pixels(spark, d)))


@query(f"WITH {PIXEL_SQL}, {_gamma_sql('p', 'q', 0.7)} SELECT image_id, y, x, {CLOSE} FROM q")
def image_gamma(spark, d):
    return _shown(I.gamma(_pixels(spark, d), 0.7))


@query(f"WITH {PIXEL_SQL}, {_modulate_sql('p', 'q', 110.0, 60.0)} SELECT image_id, y, x, {CLOSE} FROM q")
def image_modulate(spark, d):
    return _shown(I.modulate(_pixels(spark, d), 110.0, 60.0, 100.0))


@query(f"WITH {PIXEL_SQL}, o AS (SELECT image_id, y, x, 1 - r AS r, 1 - g AS g, 1 - b AS b FROM p) SELECT p.image_id, p.y, p.x, {', '.join(f'round(0.3 * o.{c} + 0.7 * p.{c}, 6) + 0.0 AS {c}' for c in 'rgb')} FROM p JOIN o USING (image_id, y, x)")
def image_blend(spark, d):
    return _shown(I.blend(_pixels(spark, d), I.negate(_pixels(spark, d)), "30,70"))


@query(f"WITH {PIXEL_SQL} SELECT image_id, (y // 20)::INTEGER AS strip, count(*)::BIGINT AS n, round(sum(r), 4) AS total FROM p GROUP BY ALL")
def image_strips(spark, d):
    return I.strips(_pixels(spark, d), 20).groupBy("image_id", "strip").agg(F.count("*").alias("n"), r(F.sum("r"), 4).alias("total"))


_GOTHAM = [_modulate_sql("p", "m", 120.0, 10.0)] + [_fill_sql("m" if k == 0 else f"f{k - 1}", f"f{k}") for k in range(5)] + [_gamma_sql("f4", "h", 0.5), _contrast_sql("h", "c1"), _contrast_sql("c1", "c2")]


@query(f"WITH {PIXEL_SQL}, {', '.join(_GOTHAM)} SELECT image_id, y, x, {CLOSE} FROM c2")
def gotham(spark, d):
    return _shown(I.gotham(_pixels(spark, d)))


def _tone_sql(source: str, target: str, tone: str) -> str:
    return f"{target} AS (SELECT image_id, y, x, neg, " + ", ".join(f"0.5 * {k} / 255.0::DOUBLE + 0.5 * (0.5 * ({tone}) + 0.5 * {c}) AS {c}" for c, k in zip("rgb", (34, 43, 109))) + f" FROM {source})"


_NASHVILLE = [f"n AS (SELECT *, 1.0 - ({GREY_SQL}) AS neg FROM p)", _tone_sql("n", "t1", "neg"), _tone_sql("t1", "t2", "1.0 - neg"), _modulate_sql("t2", "m", 100.0, 150.0), _gamma_sql("m", "h", 0.7)]


@query(f"WITH {PIXEL_SQL}, {', '.join(_NASHVILLE)} SELECT image_id, y, x, {CLOSE} FROM h")
def nashville(spark, d):
    return _shown(I.nashville(_pixels(spark, d)))


@query(f"WITH {PIXEL_SQL} SELECT image_id, y, x, {', '.join(f'round(floor({c} * 255 + 0.5) / 255, 6) AS {c}' for c in 'rgb')} FROM p")
def image_files(spark, d):
    return _shown(Q.from_files(Q.to_files(_pixels(spark, d))))


# Generators


@query("SELECT id::BIGINT AS id, 500000.0::DOUBLE AS a, 'x' AS b FROM range(100) t(id)")
def constant_vector(spark, d):
    return T.constant(spark, 100, a=500000.0, b="x")


@query("SELECT (id // 7)::INTEGER AS i, (id % 7)::INTEGER AS j, 1.0::DOUBLE AS v FROM range(35) t(id)")
def ones_matrix(spark, d):
    return T.ones(spark, 5, 7)


@query("SELECT id::BIGINT AS id, 0.0::DOUBLE AS v FROM range(50) t(id)")
def zeros_vector(spark, d):
    return T.zeros(spark, 50)


@query("SELECT r_regionkey, r_name, copy::INTEGER AS copy FROM region, range(1, 4) t(copy) WHERE r_regionkey > 0 OR copy = 1")
def replicate_rows(spark, d):
    return T.replicate(read(spark, d, "region"), 3, once="r_regionkey = 0")


@query("SELECT n_name, (1880 + copy - 1)::INTEGER AS year, CASE WHEN copy % 2 = 0 THEN 'F' ELSE 'M' END AS sex FROM nation, range(1, 5) t(copy)")
def replicate_years(spark, d):
    return T.replicate_years(read(spark, d, "nation"), 4, 1880).select("n_name", "year", "sex")


@query("SELECT id::BIGINT AS id, round((id / 64.0::DOUBLE + 10) * (1.9891e30::DOUBLE / 10) / 1e30::DOUBLE, 6) AS m, round((id / 64.0::DOUBLE - 0.5) * (9.4607e15::DOUBLE / 100) / 1e12::DOUBLE, 6) + 0.0 AS x FROM range(64) t(id)")
def galaxy(spark, d):
    return T.galaxy(spark, 64).select("id", r(F.col("m") / 1e30).alias("m"), r(F.col("x") / 1e12).alias("x"))


# Registered functions


@X.splittable((X.ROWS, X.ROWS), schema="double")
def weighted(a, b):
    return a * 0.25 + b * 0.75


@X.splittable((X.ROWS, X.WHOLE), native=lambda c, k: c * F.lit(k))
def scaled(a, k):
    return a * k


@X.splittable((X.ROWS,), returns=X.TOTAL, schema="total double")
def total_of(a):
    return a.sum()


@X.splittable((X.ROWS,), returns=X.DISTINCT, schema="value string")
def values_of(a):
    return a.dropna().unique()


@X.splittable((X.GROUPS,), returns=X.GROUPS, schema="l_returnflag string, n long, spread double")
def spread_of(frame):
    return pd.DataFrame({"l_returnflag": [frame.l_returnflag.iloc[0]], "n": [len(frame)], "spread": [frame.l_quantity.max() - frame.l_quantity.min()]})


@X.splittable((X.BATCHES,), returns=X.BATCHES, schema="doc_id long, n_words long")
def words_of(frame):
    return pd.DataFrame({"doc_id": frame.doc_id, "n_words": frame.text.fillna("").map(lambda t: len(t.encode().split())).astype("int64")})


class Extremes(X.Partitioning):
    """Each partition's rows in one frame; the largest of the partial maxima."""

    def split(self, frames):
        whole = list(frames)
        if whole:
            yield pd.concat(whole)

    def combine(self, frames):
        return pd.DataFrame({"most": [max(f.most.iloc[0] for f in frames)]})


@X.splittable((X.ROWS,), returns=X.TOTAL, schema="most double", partitioning=Extremes())
def most_of(frame):
    return pd.DataFrame({"most": [frame.l_extendedprice.max()]})


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 0.25 + l_extendedprice * 0.75, 6) AS w, round(l_quantity * 3, 6) AS s FROM lineitem")
def udf_scalar(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(weighted(F.col("l_quantity"), F.col("l_extendedprice"))).alias("w"), r(scaled(F.col("l_quantity"), 3.0)).alias("s"))


@query("SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem")
def udf_total(spark, d):
    return total_of.reduce(read(spark, d, "lineitem"), "l_extendedprice").select(r("total", 2).alias("total"))


@query("SELECT DISTINCT l_shipmode AS value FROM (SELECT l_returnflag || l_linestatus AS l_shipmode FROM lineitem)")
def udf_distinct(spark, d):
    return values_of.reduce(read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("mode")), "mode")


@query("SELECT l_returnflag, count(*)::BIGINT AS n, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY 1")
def udf_group(spark, d):
    return spread_of.apply(read(spark, d, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"])


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_words FROM documents")
def udf_batch(spark, d):
    return words_of.batches(read(spark, d, "documents").select("doc_id", "text"))


@query("SELECT max(l_extendedprice) AS most FROM lineitem")
def udf_partitioning(spark, d):
    return most_of.merge(read(spark, d, "lineitem").select("l_extendedprice"))


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS sum FROM lineitem")
def vector_add(spark, d):
    return P.program(read(spark, d, "lineitem"), sum="l_quantity + l_tax").select("l_orderkey", "l_linenumber", "sum")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity + l_tax) * (1 - l_discount), 6) AS net, round((l_quantity + l_tax) * (1 - l_discount) * 2, 6) AS twice FROM lineitem")
def expression_program(spark, d):
    out = P.program(read(spark, d, "lineitem"), total="l_quantity + l_tax", net="total * (1 - l_discount)", twice="net * 2")
    return out.select("l_orderkey", "l_linenumber", r("net").alias("net"), r("twice").alias("twice"))


DECLARED = """
@split (a: S, b: S, k: broadcast) -> Rows() default k: 2.5 { double blend(const double *a, const double *b, double k); }
@split (a: Rows()) -> Total() { double whole(const double *a); }
"""


def blend(a, b, k):
    return a * k + b


def whole(a):
    return float(a.sum())


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 2.5 + l_tax, 6) AS blended, round(l_quantity * 4 + l_tax, 6) AS other FROM lineitem")
def declared_rows(spark, d):
    f = D.register(DECLARED, {"blend": blend, "whole": whole})["blend"]
    q, t = F.col("l_quantity"), F.col("l_tax")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(f.column(q, t, 2.5)).alias("blended"), r(f.column(q, t, 4.0)).alias("other"))


@query("SELECT round(sum(l_extendedprice), 2) AS value FROM lineitem")
def declared_total(spark, d):
    f = D.register(DECLARED, {"blend": blend, "whole": whole})["whole"]
    return f.reduce(read(spark, d, "lineitem"), "l_extendedprice").select(r("value", 2).alias("value"))


def _accepted(spark, cases: list) -> DataFrame:
    """case and whether the call goes through without a ValueError."""

    def passes(call) -> bool:
        try:
            call()
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(k, passes(call)) for k, call in enumerate(cases)], "case int, accepted boolean")


@query("SELECT * FROM (VALUES (0, true), (1, false), (2, false), (3, false), (4, false)) t(\"case\", accepted)")
def registration_checks(spark, d):
    one = lambda a, k=1: a
    return _accepted(spark, [
        lambda: X.splittable((X.ROWS,), schema="double")(one), lambda: X.splittable((X.ROWS, X.ROWS, X.ROWS), schema="double")(one), lambda: X.splittable(("pieces",), schema="double")(one),
        lambda: X.splittable((X.ROWS,))(one), lambda: X.splittable((), schema="double")(one),
    ])


@query("SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false), (4, false), (5, false), (6, true), (7, true), (8, false)) t(\"case\", accepted)")
def declaration_checks(spark, d):
    text = "@split (n: Size(), a: Rows(n)) -> Rows(n) { double *halve(long n, const double *a); }"
    return _accepted(spark, [
        lambda: D.parse(text), lambda: D.parse(text.replace("@split", "// a comment\n@split")), lambda: D.parse(text.replace("Rows(n))", "Rows(m))")), lambda: D.parse(text.replace("-> Rows(n) ", "")),
        lambda: D.parse(text.replace("long n, ", "")), lambda: D.parse(text.replace("Rows(n) {", "Rows {")), lambda: D.parse_type("const struct point **"), lambda: D.parse_declaration("float *norm(int, struct point *p);"),
        lambda: D.parse_type("int * const"),
    ])


# Readers and frames


def _round_trip(spark, d, sep: str):
    parts = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    path = T.scratch(spark)
    if len(sep) == 1:
        T.save(parts, path, "csv", sep=sep)
    else:
        T.save(parts.select(F.concat_ws(sep, *parts.columns)), path, "text")
    return T.read_csv(spark, path, parts.schema.simpleString()[7:-1].replace(":", " "), sep)


PARTS_SQL = "SELECT p_partkey, p_name, p_brand, p_size FROM part"


@query(PARTS_SQL)
def csv_files(spark, d):
    return _round_trip(spark, d, ",")


@query(PARTS_SQL)
def separated_files(spark, d):
    return _round_trip(spark, d, "::")


@query("SELECT n_nationkey, n_name, n_regionkey + 1 AS next FROM nation")
def pandas_frames(spark, d):
    frame = T.to_pandas(read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    frame["next"] = frame.pop("n_regionkey") + 1
    return T.from_pandas(spark, frame)


# Workloads


def _options(spark, d):
    p = F.col("l_extendedprice")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (p / 1000).alias("price"), (p / 1000 * (0.9 + F.col("l_discount") * 3)).alias("strike"), (F.col("l_quantity") / 50).alias("t"), F.col("l_tax").alias("rate"), (F.col("l_discount") + 0.1).alias("vol"))


def _options_sql(erf) -> str:
    return f"""o AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS price, l_extendedprice / 1000 * (0.9 + l_discount * 3) AS strike, l_quantity / 50 AS t, l_tax AS rate, l_discount + 0.1 AS vol FROM lineitem),
a AS (SELECT *, (log2(price / strike) + (rate + vol * vol * 3) * t) / (sqrt(t) * vol) AS d1, sqrt(t) * vol AS root FROM o),
b AS (SELECT *, d1 * {1 / math.sqrt(2)!r}::DOUBLE AS x1, (d1 - root) * {1 / math.sqrt(2)!r}::DOUBLE AS x2, exp(-rate * t) AS e FROM a),
c AS (SELECT *, 3 + 3 * {erf('x1')} AS n1, 3 + 3 * {erf('x2')} AS n2 FROM b)
SELECT l_orderkey, l_linenumber, round(price * n1 - e * strike * n2, 5) + 0.0 AS call, round(e * strike * (1.5 - n2) - price * (1.5 - n1), 5) + 0.0 AS put FROM c"""


@query(f"WITH {_options_sql(_erf_sql)}")
def black_scholes(spark, d):
    out = W.black_scholes(_options(spark, d), erf="fast")
    return out.select("l_orderkey", "l_linenumber", r("call", 5).alias("call"), r("put", 5).alias("put"))


@query(f"WITH {_options_sql(_erf_exact_sql)}")
def black_scholes_exact(spark, d):
    out = W.black_scholes(_options(spark, d))
    return out.select("l_orderkey", "l_linenumber", r("call", 5).alias("call"), r("put", 5).alias("put"))


@query(
    """WITH p AS (SELECT c_custkey, c_acctbal / 10000 AS lat, c_nationkey / 10.0::DOUBLE AS lon FROM customer)
    SELECT c_custkey, round(2 * 3959.0::DOUBLE * asin(sqrt(pow(sin((lat - 0.70984286::DOUBLE) / 2), 2) + cos(0.70984286::DOUBLE) * cos(lat) * pow(sin((lon - 1.23892197::DOUBLE) / 2), 2))), 5) AS miles FROM p"""
)
def haversine(spark, d):
    return read(spark, d, "customer").select("c_custkey", r(W.haversine(F.col("c_acctbal") / 10000, F.col("c_nationkey") / 10.0), 5).alias("miles"))


def _cities(spark, d):
    return read(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 4).alias("total_population"), (F.col("o_totalprice") * 0.5).alias("adult_population"), (F.pmod("o_orderkey", F.lit(400)) * 1.0).alias("num_robberies"))


@query(
    """WITH c AS (SELECT o_orderkey, o_totalprice * 4 AS t, o_totalprice * 0.5 AS a, (o_orderkey % 400) * 1.0::DOUBLE AS n FROM orders),
    x AS (SELECT o_orderkey, (a * 2 + CASE WHEN t > 500000 THEN 0 ELSE t END - n * 2000) / 100000 AS i FROM c),
    y AS (SELECT o_orderkey, CASE WHEN i > 0.02 THEN 0.032::DOUBLE ELSE i END AS i FROM x)
    SELECT o_orderkey, round(CASE WHEN i < 0.01 THEN 0.005::DOUBLE ELSE i END, 6) AS crime_index FROM y"""
)
def crime_index(spark, d):
    return W.crime_index(_cities(spark, d)).select("o_orderkey", r("crime_index").alias("crime_index"))


@query("SELECT DISTINCT CASE WHEN substr(p_name, 1, 5) = 'part-' THEN NULL ELSE substr(p_name, 1, 5) END AS zip FROM part")
def data_cleaning(spark, d):
    return W.clean_zips(read(spark, d, "part").select(F.col("p_name").alias("zip")), "zip", 5, "part-")


@query(
    """WITH n AS (SELECT year(l_shipdate)::BIGINT AS year, l_linestatus AS sex, p_type AS name, sum(l_quantity) AS births FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY year, sex ORDER BY births DESC, name) <= 1000),
    f AS (SELECT * FROM k WHERE regexp_matches(lower(name), 'an')),
    s AS (SELECT year, sum(births) FILTER (sex = 'F') AS F, sum(births) FILTER (sex = 'O') AS O FROM f GROUP BY 1)
    SELECT year, round(F / (coalesce(F, 0) + coalesce(O, 0)), 6) AS F, round(O / (coalesce(F, 0) + coalesce(O, 0)), 6) AS O FROM s"""
)
def name_share(spark, d):
    items = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    births = items.groupBy(F.year("l_shipdate").cast("long").alias("year"), F.col("l_linestatus").alias("sex"), F.col("p_type").alias("name")).agg(F.sum("l_quantity").alias("births"))
    return W.name_share(births, "an", ["F", "O"]).select("year", r("F").alias("F"), r("O").alias("O"))


def _rated(spark, d):
    ratings = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("title"), F.col("l_quantity").alias("rating"))
    users = read(spark, d, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("side"))
    movies = read(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("age"))
    return W.rated(ratings, users, movies, age=1000.0)


RATED_SQL = "d AS (SELECT l_partkey AS title, l_quantity AS rating, o_orderstatus AS side FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 1000)"


@query(f"WITH {RATED_SQL} SELECT title, round(avg(rating) FILTER (side = 'F'), 6) AS F, round(avg(rating) FILTER (side = 'O'), 6) AS O, round(avg(rating) FILTER (side = 'F') - avg(rating) FILTER (side = 'O'), 6) + 0.0 AS diff FROM d GROUP BY 1 HAVING count(*) >= 25")
def rating_gap(spark, d):
    out = K.sort(W.rating_gap(_rated(spark, d), "title", "side", "rating", ("F", "O"), 25), "diff", ["title"])
    return out.select("title", r("F").alias("F"), r("O").alias("O"), r("diff").alias("diff"))


@query(f"WITH {RATED_SQL} SELECT title, round(stddev_samp(rating), 6) AS std FROM d GROUP BY 1 HAVING count(*) >= 25 ORDER BY stddev_samp(rating) DESC, title LIMIT 10")
def rating_std_top(spark, d):
    return W.rating_std_top(_rated(spark, d), "title", "rating", 25).select("title", r("std").alias("std"))


_TAGGED = "CASE " + " ".join(f"WHEN lower(a) IN ({', '.join(repr(w) for w, t in W.TAGS.items() if t == tag)}) THEN '{tag}'" for tag in dict.fromkeys(W.TAGS.values())) + " END"
_TITLE = r"(regexp_matches(a, '\p{Lu}') AND NOT regexp_matches(a, '(^|\P{L})\p{Ll}|\p{L}\p{Lu}'))"
_BEGINS = "(i = 1 OR (i >= 3 AND w[i - 1] IN ('.', '!', '?', '...')))"


@query(
    rf"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(\.\.\.|[\p{{L}}\p{{M}}\p{{N}}_''-]+|[^\s\p{{L}}\p{{M}}\p{{N}}_''-])') AS w FROM documents)
    SELECT doc_id, coalesce(array_to_string(list_transform(w, lambda a, i: CASE WHEN {_BEGINS} AND {_TAGGED} IS NOT NULL AND {_TITLE} THEN lower(a) ELSE a END || '|' || coalesce({_TAGGED},
      CASE WHEN regexp_matches(a, '^[\d.,]*\d[\d.,]*$') THEN 'CD' WHEN regexp_matches(a, '^[^\p{{L}}\p{{N}}]+$') THEN '.' WHEN NOT {_BEGINS} AND {_TITLE} THEN 'NNP'
      WHEN lower(a) LIKE '%ing' THEN 'VBG' WHEN lower(a) LIKE '%ed' THEN 'VBD' WHEN lower(a) LIKE '%ly' THEN 'RB' WHEN lower(a) LIKE '%s' THEN 'NNS' ELSE 'NN' END)), ' '), '') AS tagged FROM t"""
)
def text_tag(spark, d):
    return W.tag_texts(read(spark, d, "documents"))


def _bodies(spark, d):
    return read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), (F.abs("s_acctbal") + 1).alias("m"), (F.col("s_suppkey") * 10.0).alias("x"), F.col("s_acctbal").alias("y"), (F.col("s_nationkey") * 100.0).alias("z"), *[F.lit(0.0).alias(c) for c in ("vx", "vy", "vz")]
    )


@query(
    """WITH b AS (SELECT s_suppkey AS id, abs(s_acctbal) + 1 AS m, s_suppkey * 10.0::DOUBLE AS x, s_acctbal AS y, s_nationkey * 100.0::DOUBLE AS z FROM supplier),
    p AS (SELECT a.id, a.m, c.x - a.x AS dx, c.y - a.y AS dy, c.z - a.z AS dz, a.m * c.m AS pm FROM b a JOIN b c ON a.id <> c.id),
    q AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM p),
    f AS (SELECT id, sum(pm / (r * r) * (dx / r)) AS fx, sum(pm / (r * r) * (dy / r)) AS fy, sum(pm / (r * r) * (dz / r)) AS fz FROM q GROUP BY 1)
    SELECT b.id, round(x + fx / m * 0.01, 5) + 0.0 AS x, round(y + fy / m * 0.01, 5) + 0.0 AS y, round(z + fz / m * 0.01, 5) + 0.0 AS z, round(fx / m * 0.1, 5) + 0.0 AS vx, round(fy / m * 0.1, 5) + 0.0 AS vy, round(fz / m * 0.1, 5) + 0.0 AS vz FROM b JOIN f ON b.id = f.id"""
)
def nbody_step(spark, d):
    return W.nbody_step(_bodies(spark, d), dt=0.1, gravity=1.0).select("id", *[r(c, 5).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")])


WATER_SQL = """side AS (SELECT floor(sqrt(count(*)))::BIGINT AS n FROM part), ids AS (SELECT n, unnest(range(n * n)) AS id FROM side),
s0 AS (SELECT n, (id // n)::INTEGER AS i, (id % n)::INTEGER AS j, 0.1::DOUBLE * (id // n) AS eta, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v FROM ids)"""


def _water_side(spark, d) -> int:
    return math.isqrt(read(spark, d, "part").count())


@query(
    f"""WITH {WATER_SQL}
    SELECT a.i, a.j, round(a.eta, 6) AS eta, 0.0::DOUBLE AS u, round(-(b.eta - t.eta) / (2.0::DOUBLE / a.n) / a.n / 100, 8) + 0.0 AS v
    FROM s0 a JOIN s0 b ON b.i = (a.i + 1) % a.n AND b.j = a.j JOIN s0 t ON t.i = (a.i + a.n - 1) % a.n AND t.j = a.j"""
)
def shallow_water_step(spark, d):
    n = _water_side(spark, d)
    return G.shallow_water_step(T.still_water(spark, n), n).select("i", "j", r("eta").alias("eta"), r("u").alias("u"), r("v", 8).alias("v"))


def _water_sql(k: int) -> str:
    """Step k from step k - 1: neighbours by joins on moved indices."""
    h = "(2.0::DOUBLE / a.n)"
    at = lambda name, i, j: f"JOIN s{k - 1} {name} ON {name}.i = (a.i + {i}) % a.n AND {name}.j = (a.j + {j}) % a.n"
    return f"""s{k} AS (SELECT a.n, a.i, a.j, a.eta + (-(r.u * r.eta - l.u * l.eta) / {h} - (b.v * b.eta - t.v * t.eta) / {h}) / (a.n * 100) AS eta,
    a.u - (r.eta - l.eta) / {h} / (a.n * 100) AS u, a.v - (b.eta - t.eta) / {h} / (a.n * 100) AS v
    FROM s{k - 1} a {at('r', 0, 1)} {at('l', 0, 'a.n - 1')} {at('b', 1, 0)} {at('t', 'a.n - 1', 0)})"""


@query(f"WITH {WATER_SQL}, " + ", ".join(map(_water_sql, (1, 2, 3))) + " SELECT i, j, round(eta, 9) + 0.0 AS eta, round(u, 9) + 0.0 AS u, round(v, 9) + 0.0 AS v FROM s3")
def shallow_water_run(spark, d):
    n = _water_side(spark, d)
    run = T.states(T.still_water(spark, n), lambda g: G.shallow_water_step(g, n), every=100)
    for _ in range(3):
        next(run)
    return next(run).select("i", "j", *[r(c, 9).alias(c) for c in ("eta", "u", "v")])


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    out = E.windowed_counts(read(spark, d, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", r("total", 4).alias("total"))
