"""Aggregations with pandas semantics for missing values."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N


def _number(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def nan_sum(column: str | Column) -> Column:
    """Sum that skips NaN and null; of nothing 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(_number(c.cast("double"))), F.lit(0.0))


def unique(df: DataFrame, column: str) -> DataFrame:
    """The different values; null is one of them, NaN another."""
    return df.select(column).distinct()


def grouped(df: DataFrame, keys: list[str], keep_missing: bool = False):
    """groupBy without the rows that lack a key, as pandas does."""
    kept = df if keep_missing else df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return kept.groupBy(*keys)


def group_size(df: DataFrame, keys: list[str]) -> DataFrame:
    return grouped(df, keys).agg(F.count("*").alias("size"))


def group_std(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sample standard deviation; null for a group of one row."""
    return grouped(df, keys).agg(F.stddev_samp(_number(F.col(column).cast("double"))).alias("std"))


def group_apply(df: DataFrame, keys: list[str], func: Callable, schema: str) -> DataFrame:
    """func(pandas frame of a whole group) -> pandas frame; groups must fit a task."""
    return grouped(df, keys).applyInPandas(func, schema)


def pivot(df: DataFrame, index: str, columns: str, values: str, how: str, labels: list) -> DataFrame:
    """One row per index, one column per label, how = sum or mean; an absent cell is null. Labels are given, so no extra pass finds them."""
    f = {"sum": F.sum, "mean": F.avg}[how]
    return grouped(df, [index, columns]).agg(f(values).alias("_v")).groupBy(index).pivot(columns, labels).agg(F.first("_v"))


def row_share(df: DataFrame, cells: list[str]) -> DataFrame:
    """Each cell divided by its row's sum; absent cells stay null and do not count."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cells[1:]), F.coalesce(F.col(cells[0]).cast("double"), F.lit(0.0)))
    return df.select(*[c for c in df.columns if c not in cells], *[N.divide(F.col(c), total).alias(c) for c in cells])


def axis_sum(matrix: DataFrame, column: str, axis: int) -> DataFrame:
    """Sums of an (i, j, value) matrix over an axis: 1 gives one value per row i, 0 one per column j."""
    return matrix.groupBy("i" if axis == 1 else "j").agg(F.sum(column).alias("total"))


def off_diagonal_sum(matrix: DataFrame, column: str) -> DataFrame:
    return matrix.where("i <> j").groupBy("i").agg(F.sum(column).alias("total"))


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.sum(sum((F.col(c) for c in columns[1:]), F.col(columns[0]))).alias("checksum"))


#: Partial results that one task combines.
FAN_IN = 64


def combined(parts: DataFrame, combine: Callable) -> DataFrame:
    """combine(pandas frame of partials) in a tree: at most FAN_IN partitions' partials meet in one task; combine must be associative."""
    schema, n = parts.schema, parts.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(n)).alias("_part")).applyInPandas(lambda f: combine(f), schema)
    return parts.groupBy().applyInPandas(lambda f: combine(f), schema)


def two_phase(df: DataFrame, partial: Callable, schema: str, combine: Callable, keys: list[str] | None = None) -> DataFrame:
    """partial(iterator of pandas frames) -> frames, combined in each partition, then combine(pandas frame of partials) per key.

    combine must be associative; without keys the partitions' partials meet in a tree.
    """

    def run(frames):
        whole = list(partial(frames))
        if whole:
            yield combine(pd.concat(whole, ignore_index=True))

    parts = df.mapInPandas(run, schema)
    return parts.groupBy(*keys).applyInPandas(combine, schema) if keys else combined(parts, combine)


def append_strips(strips: DataFrame, image: str = "image_id", order: str = "y", data: str = "strip") -> DataFrame:
    """Strips of each image in order, as one array."""
    return strips.groupBy(image).agg(F.array_sort(F.collect_list(F.struct(order, data))).alias("_s")).select(image, F.col("_s").getField(data).alias("strips"))
