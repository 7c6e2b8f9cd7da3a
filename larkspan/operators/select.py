"""Row and column selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N


def filter_greater(df: DataFrame, column: str, target: float) -> DataFrame:
    """Rows whose column is above target; neither null nor NaN is. A plain comparison, so that it reaches the scan."""
    kept = df.filter(F.col(column) > F.lit(target))
    return kept.filter(~F.isnan(column)) if dict(df.dtypes)[column] in ("double", "float") else kept


def where_mask(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def negate(condition: Column) -> Column:
    return ~condition


def is_in(df: DataFrame, column: str, values: DataFrame | list) -> DataFrame:
    """Rows whose column is among the values: a list, or the first column of another frame (a semi join)."""
    if isinstance(values, list):
        return df.filter(F.col(column).isin(values))
    other = values.select(F.col(values.columns[0]).alias("_v"))
    return df.join(other, F.col(column).eqNullSafe(F.col("_v")), "left_semi")


def label_rows(df: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """Rows that a label selects; the labels' key column has the same name."""
    return df.join(labels.select(key), key, "left_semi")


def having(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Keys of the groups with at least so many rows, and their sizes."""
    return df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count("*").alias("size")).filter(F.col("size") >= least)


def derive(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def positions(df: DataFrame, id_column: str, start: int, end: int) -> DataFrame:
    """The rows start to end - 1 by an explicit, gapless id."""
    return df.filter((F.col(id_column) >= start) & (F.col(id_column) < end))


def reshape(df: DataFrame, id_column: str, n: int) -> DataFrame:
    """Adds row i and column j of an n-wide matrix to a flat vector."""
    return df.withColumn("i", F.expr(f"cast({id_column} div {n} AS int)")).withColumn("j", (F.col(id_column) % n).cast("int"))


def flatten(df: DataFrame, n: int, id_column: str = "id") -> DataFrame:
    return df.withColumn(id_column, F.col("i").cast("long") * n + F.col("j"))


def fill_diagonal(df: DataFrame, column: str, value: float) -> DataFrame:
    return df.withColumn(column, N.mask(F.col(column), F.col("i") == F.col("j"), value))


def length(df: DataFrame) -> int:
    return df.count()


def program(df: DataFrame, **steps: str) -> DataFrame:
    """df with columns that expressions in SQL text give, each of which may use those before it; all stays in generated code."""
    for name, text in steps.items():
        df = df.withColumn(name, F.expr(text))
    return df
