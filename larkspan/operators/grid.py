"""Periodic grids as (i, j, value) relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N


def roll(value: str | Column, shift: int, axis: int) -> Column:
    """The value `shift` places before along the axis (1 or -1), with wrap-around, as a window along one line of the grid."""
    along, across = ("i", "j") if axis == 0 else ("j", "i")
    v = F.col(value) if isinstance(value, str) else value
    line = Window.partitionBy(across).orderBy(along)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if shift == -1:
        return F.coalesce(F.lead(v, 1).over(line), F.first(v).over(whole))
    if shift == 1:
        return F.coalesce(F.lag(v, 1).over(line), F.last(v).over(whole))
    raise ValueError("shift is 1 or -1; repeat it for more")


def central_difference(value: str, axis: int, spacing: float) -> Column:
    return N.divide(roll(value, -1, axis) - roll(value, 1, axis), spacing * 2.0)


def shallow_water_step(grid: DataFrame, n: int, g: float = 1.0, b: float = 0.0, box: float = 1.0) -> DataFrame:
    """One Euler step of the shallow-water equations on i, j, eta, u, v.

    Two exchanges, one per axis, whatever the number of derivatives taken along it.
    """
    h = box / n
    dt = h / 100.0
    flux = grid.select("*", (F.col("u") * F.col("eta")).alias("ue"), (F.col("v") * F.col("eta")).alias("ve"))
    x = flux.select("*", central_difference("eta", 1, h).alias("dex"), central_difference("ue", 1, h).alias("dux"))
    y = x.select("*", central_difference("eta", 0, h).alias("dey"), central_difference("ve", 0, h).alias("dvy"))
    return y.select(
        "i",
        "j",
        (F.col("eta") + (-F.col("dux") - F.col("dvy")) * dt).alias("eta"),
        (F.col("u") + (-g * F.col("dex") - b * F.col("u")) * dt).alias("u"),
        (F.col("v") + (-g * F.col("dey") - b * F.col("v")) * dt).alias("v"),
    )
