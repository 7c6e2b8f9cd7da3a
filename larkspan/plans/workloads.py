"""The whole workloads, each one lazy plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import strings as S
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import select as P
from ..operators import topk as K
from ..sources.tables import GRAVITY, YEAR, spread

# The option-pricing workload's two constants, and the point and radius of the distance workload.
HALF, ONE = 3.0, 1.5
LAT, LON, MILES = 0.70984286, 1.23892197, 3959.0


def black_scholes(df: DataFrame, log: str = "log2", erf: str = "exact") -> DataFrame:
    """Adds call and put to price, strike, t, rate, vol; the logarithm is log2, log or log1p."""
    p, k, t, r, v = (F.col(c) for c in ("price", "strike", "t", "rate", "vol"))
    rsig = r + v * v * HALF
    root = N.sqrt(t) * v
    d1 = N.divide(getattr(N, log)(N.divide(p, k)) + rsig * t, root)
    out = df.select("*", d1.alias("_d1"), root.alias("_root"))
    side = lambda d: HALF + HALF * N.erf(d * (1.0 / math.sqrt(2.0)), erf)
    out = out.select("*", side(F.col("_d1")).alias("_n1"), side(F.col("_d1") - F.col("_root")).alias("_n2"), N.exp(-r * t).alias("_e"))
    call = p * F.col("_n1") - F.col("_e") * k * F.col("_n2")
    put = F.col("_e") * k * (ONE - F.col("_n2")) - p * (ONE - F.col("_n1"))
    return out.select(*df.columns, call.alias("call"), put.alias("put"))


def haversine(lat: Column, lon: Column, lat1: float = LAT, lon1: float = LON) -> Column:
    """Miles to a fixed point, angles in radians."""
    dlat, dlon = N.sin((lat - lat1) / 2.0), N.sin((lon - lon1) / 2.0)
    return 2.0 * MILES * N.arcsin(N.sqrt(dlat * dlat + math.cos(lat1) * N.cos(lat) * dlon * dlon))


def crime_index(df: DataFrame, inclusive: bool = False) -> DataFrame:
    """Adds crime_index to total_population, adult_population, num_robberies; inclusive bounds on request."""
    above = N.greater_equal if inclusive else N.greater
    total = F.col("total_population")
    big = N.mask(total, above(total, 500000.0), 0.0)
    raw = (F.col("adult_population") * 2.0 + big - F.col("num_robberies") * 2000.0) / 100000.0
    out = df.select("*", raw.alias("_raw"))
    capped = N.mask(F.col("_raw"), above(F.col("_raw"), 0.02), 0.032)
    out = out.select(*df.columns, capped.alias("_raw"))
    return out.select(*df.columns, N.mask(F.col("_raw"), N.less(F.col("_raw"), 0.01), 0.005).alias("crime_index"))


def clean_zips(df: DataFrame, column: str, digits: int = 5, bad: str = "00000") -> DataFrame:
    """The different prefixes of the column; the bad one is null."""
    cut = S.slice_text(F.col(column), 0, digits)
    return A.unique(df.select(N.mask(cut, S.same(cut, bad), None).alias(column)), column)


def name_share(df: DataFrame, pattern: str, sexes: list[str], k: int = 1000) -> DataFrame:
    """Per year, each sex's share of the births of names that match, among the k commonest names of a year and sex."""
    top = K.group_top(df, ["year", "sex"], "births", k, ["name"])
    like = top.where(S.contains(S.lower(F.col("name")), pattern)).select("name").distinct()
    return A.row_share(A.pivot(P.is_in(top, "name", like), "year", "sex", "births", "sum", sexes), sexes)


def rated(ratings: DataFrame, users: DataFrame, movies: DataFrame, age: float = 45) -> DataFrame:
    return P.filter_greater(J.chain_merge(ratings, users, movies), "age", age)


def rating_gap(data: DataFrame, key: str, side: str, value: str, sides: tuple[str, str], least: int) -> DataFrame:
    """Mean value per key and side, their difference (first minus second), for keys with enough rows.

    Means and sizes come from one aggregation by key, so the data is shuffled once.
    """
    a, b = sides
    mean = lambda s: F.avg(F.when(F.col(side) == s, F.col(value)))
    out = A.grouped(data, [key]).agg(mean(a).alias(a), mean(b).alias(b), F.count("*").alias("size")).where(F.col("size") >= least)
    return out.select(key, a, b, (F.col(a) - F.col(b)).alias("diff"))


def rating_std_top(data: DataFrame, key: str, value: str, least: int, k: int = 10) -> DataFrame:
    out = A.grouped(data, [key]).agg(F.stddev_samp(value).alias("std"), F.count("*").alias("size")).where(F.col("size") >= least)
    return K.top(out.select(key, "std"), "std", k, [key])


# Closed-class words of English with their tags, for the rule tagger.
TAGS = {
    "the": "DT", "a": "DT", "an": "DT", "this": "DT", "that": "DT", "of": "IN", "in": "IN", "on": "IN", "at": "IN", "by": "IN", "for": "IN", "from": "IN", "with": "IN",
    "to": "TO", "and": "CC", "or": "CC", "but": "CC", "he": "PRP", "she": "PRP", "it": "PRP", "they": "PRP", "we": "PRP", "you": "PRP", "i": "PRP", "is": "VBZ", "was": "VBD", "are": "VBP", "be": "VB", "not": "RB",
}


def tag_texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, tagged: every token as word|tag, sentence-initial title words lowered where their lower form is a closed-class word.

    A rule tagger stands for a statistical one: closed-class words by list, then
    numbers, punctuation, names within a sentence, and endings.
    """
    words = spread(docs.select(id_column, text)).select(id_column, S.without_space(S.tokens(F.coalesce(F.col(text), F.lit("")))).alias("_w"))
    words = words.select(id_column, "_w", S.sentence_begins(F.col("_w")).alias("_b"))
    by_tag: dict = {}
    for word, tag in TAGS.items():
        by_tag.setdefault(tag, []).append(word)

    def closed(low: Column) -> Column:
        """Tag of a closed-class word; the words are short, so a longer one is passed over at once."""
        tag = F.lit(None).cast("string")
        for t, words_ in by_tag.items():
            tag = F.when(low.isin(words_), t).otherwise(tag)
        return F.when(F.length(low) <= max(map(len, TAGS)), tag)

    def one(w: Column, i: Column) -> Column:
        low = F.lower(w)
        known = closed(low)
        begins = F.get(F.col("_b"), i)
        shown = F.when(begins & known.isNotNull() & S.is_title(w), low).otherwise(w)
        tag = F.coalesce(
            known,
            F.when(w.rlike(r"^[\d.,]*\d[\d.,]*$"), "CD").when(w.rlike(r"^[^\p{L}\p{N}]+$"), ".").when(~begins & S.is_title(w), "NNP").when(low.endswith("ing"), "VBG").when(low.endswith("ed"), "VBD").when(low.endswith("ly"), "RB").when(low.endswith("s"), "NNS").otherwise("NN"),
        )
        return F.concat(shown, F.lit("|"), tag)

    return words.select(id_column, S.join(F.transform(F.col("_w"), one)).alias("tagged"))


def nbody_step(bodies: DataFrame, dt: float = YEAR, gravity: float = GRAVITY, pairs: DataFrame | None = None) -> DataFrame:
    """One Euler step of all bodies (id, m, x, y, z, vx, vy, vz) under each other's gravity."""
    p = J.pairs(bodies, "id", ["m", "x", "y", "z"]) if pairs is None else pairs
    d = {c: F.col(f"b_{c}") - F.col(f"a_{c}") for c in "xyz"}
    p = p.select("ida", "a_m", "b_m", *[v.alias(f"d{c}") for c, v in d.items()])
    p = p.withColumn("r", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    # the pull of b on a, by a's mass: G m_b / r^2 towards b
    pull = gravity * N.divide(F.col("a_m") * F.col("b_m"), F.col("r") * F.col("r"))
    force = p.groupBy(F.col("ida").alias("id")).agg(*[F.sum(pull * N.divide(F.col(f"d{c}"), F.col("r"))).alias(f"f{c}") for c in "xyz"])
    moved = bodies.join(force, "id", "left")
    v = {c: F.col(f"v{c}") + N.divide(F.coalesce(F.col(f"f{c}"), F.lit(0.0)), N.divide(F.col("m"), dt)) for c in "xyz"}
    out = moved.select("id", "m", "x", "y", "z", *[e.alias(f"v{c}") for c, e in v.items()])
    return out.select("id", "m", *[(F.col(c) + F.col(f"v{c}") * dt).alias(c) for c in "xyz"], "vx", "vy", "vz")
