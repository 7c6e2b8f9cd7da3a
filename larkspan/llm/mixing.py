"""Mixing sources to target weights: hash-random order, distributed prefix sums, a cut at each source's exact budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, WORD, doc_key, sent_if_small, table

def targets(sums: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """sums (source, s, ...) with target: its weight's share of all sizes, but at most `most` times its size.

    Sources come in order of code points, null last, and take the weights in
    turn; their places follow from ranges, numbered in parallel and moved by
    the counts of the ranges before. The excess above the limits is reshared by
    weight until no source is above, one aggregation a round; then
    target = least(limit, weight * level).
    """
    spark = sums.sparkSession
    # UTF-8 bytes order as code points do
    ranged = sums.withColumn("_null", F.col("source").isNull()).repartitionByRange("_null", "source").withColumn("_range", F.spark_partition_id())
    ranged = table(ranged, "sources")
    counts = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())  # one row a partition
    before = [0]
    for _, n in counts:
        before.append(before[-1] + n)
    start = spark.createDataFrame([(k, b) for (k, _), b in zip(counts, before)], "_range int, _first long")
    place = F.col("_first") + F.row_number().over(Window.partitionBy("_range").orderBy("_null", "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = table(ranged.join(F.broadcast(start), "_range").withColumn("_w", weight).withColumn("_limit", F.lit(float(most)) * F.col("s")).drop("_null", "_range", "_first"), "ranked")
    total = float(ranked.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0])
    level, capped = None, 0
    while True:
        above = F.lit(False) if level is None else F.col("_limit") < F.col("_w") * F.lit(level)
        spent, open_weight, n = ranked.agg(F.sum(F.when(above, F.col("_limit")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("_w"))), F.sum(above.cast("long"))).first()
        if not open_weight or (level is not None and n == capped):
            break
        level, capped = (total - spent) / open_weight, n
    return ranked.withColumn("target", F.least("_limit", F.col("_w") * F.lit(level or 0.0))).drop("_w", "_limit")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, rows_per_group: int = 4096) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, taken of every row of docs.

    Each source gives whole epochs of itself while its target allows, then the
    rows that come first by a hash of doc_id until the target, rounded down to
    a word, is used up; the row at the cut gives part of its words. A null text
    has size 0, a null source is a source of its own, rows with the same id
    follow each other by size and by the hash of their text, so reruns agree; no rows
    give no rows. A source's rows are dealt by hash into groups, whose prefix
    sums are taken in parallel and moved by the sums of the groups before.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hexed = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15)
    picked = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.conv(hexed, 16, 10).cast("long").alias("_key"), F.xxhash64(text).alias("_row"))
    rows = table(picked, "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    plan = targets(sums, weights, most).select(F.col("source").alias("_s"), F.col("s").alias("source_size"), "target", F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_group)).cast("long").alias("_groups"))
    known = rows.join(sent_if_small(table(plan, "plan")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # the key has 60 bits; equal slices of its range, in order
    known = known.withColumn("_group", F.floor(F.col("_key").cast("double") / F.lit(float(2**60)) * F.col("_groups")))
    sizes = known.groupBy("source", "_group").agg(F.sum("size").alias("n"))
    before = sizes.select(F.col("source").alias("_s"), F.col("_group").alias("_g"), (F.sum("n").over(Window.partitionBy("source").orderBy("_group")) - F.col("n")).alias("_before"))
    order = Window.partitionBy("source", "_group").orderBy("_key", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = known.withColumn("_upto", F.sum("size").over(order))
    placed = ranked.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_group") == F.col("_g")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - (F.col("_before") + F.col("_upto") - F.col("size"))))
    return placed.select("doc_id", F.col("_row").alias("text_hash"), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def draw(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them; the row at a source's cut if at least half of it fits.

    Rows that agree in id and text are taken alike, as the one of them that is
    taken most. Rows without words, null texts too, are never taken; a null
    source is a source of its own; no rows give no rows.
    """
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    plan = mix(docs, weights, most).where("taken > 0").groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("__lk_did"), F.col("text_hash").alias("__lk_row")).agg(F.max(times).alias("__lk_times")).where("__lk_times > 0")
    row = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    taken = docs.join(table(plan, "plan"), (doc_key() == F.col("__lk_did")) & (row == F.col("__lk_row")))
    return taken.withColumn("__lk_copy", F.explode(F.sequence(F.lit(1), F.col("__lk_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
