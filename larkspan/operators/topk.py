"""Orders, limits, top rows of groups, unions. Ties are broken by a given key, so results are fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_top(df: DataFrame, keys: list[str], by: str, k: int, tie: list[str]) -> DataFrame:
    """The k rows of each group with the largest `by`; Spark prunes groups before they travel (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), *tie)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def sort(df: DataFrame, by: str, tie: list[str], ascending: bool = True) -> DataFrame:
    """Missing values last, as pandas puts them."""
    first = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(first, *tie)


def top(df: DataFrame, by: str, k: int, tie: list[str]) -> DataFrame:
    return sort(df, by, tie, ascending=False).limit(k)


def head(df: DataFrame, by: str, tie: list[str], k: int = 5) -> DataFrame:
    return sort(df, by, tie).limit(k)


def last_by_id(df: DataFrame, id_column: str, k: int) -> DataFrame:
    return df.orderBy(F.col(id_column).desc()).limit(k)


def stack(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
