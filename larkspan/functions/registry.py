"""Registering ordinary functions with how their arguments divide and how their results merge.

Kinds of an argument or result: rows (a column, divided by rows), whole (the
same value for every part), total (partial sums that add up), distinct (partial
sets that unite), groups (whole groups of rows), batches (an iterator of
frames). A registered function becomes a native Column where one is given, else
a pandas UDF, an aggregation of partials, or a grouped or partition-wise map.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, WHOLE, TOTAL, DISTINCT, GROUPS, BATCHES = "rows", "whole", "total", "distinct", "groups", "batches"
KINDS = (ROWS, WHOLE, TOTAL, DISTINCT, GROUPS, BATCHES)


class Partitioning:
    """A way to divide a frame and to merge what becomes of the parts; subclass it for one of your own.

    split(frames) turns the iterator of a partition's pandas frames into the
    frames that the function gets; combine(frames) merges partial results and
    must be associative; elements(df) is the number of rows that it divides.
    """

    def split(self, frames):
        yield from frames

    def combine(self, frames: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(frames, ignore_index=True)

    def elements(self, df: DataFrame) -> int:
        return df.count()


@dataclass
class Registered:
    func: Callable
    args: tuple[str, ...]
    returns: str
    schema: str | None = None
    native: Callable | None = None
    partitioning: Partitioning = field(default_factory=Partitioning)

    def __call__(self, *args, **kwargs):
        """On columns a column, on anything else the plain function."""
        if any(isinstance(a, Column) for a in args):
            return self.column(*args, **kwargs)
        return self.func(*args, **kwargs)

    def column(self, *args, native: bool = True) -> Column:
        if self.returns != ROWS:
            raise TypeError(f"{self.func.__name__} does not return rows")
        if len(args) != len(self.args):
            raise TypeError(f"{self.func.__name__} takes {len(self.args)} arguments")
        if native and self.native:
            return self.native(*args)
        fixed = {i: a for i, (a, k) in enumerate(zip(args, self.args)) if k == WHOLE}
        cols = [a if isinstance(a, Column) else F.lit(a) for i, a in enumerate(args) if i not in fixed]
        func, n = self.func, len(args)

        def over(*series: pd.Series) -> pd.Series:
            given = iter(series)
            return func(*[fixed[i] if i in fixed else next(given) for i in range(n)])

        return F.pandas_udf(over, self.schema)(*cols)

    def reduce(self, df: DataFrame, *args) -> DataFrame:
        """One row for a total, one per value for a distinct result; columns by name, other arguments as they are."""
        columns = [a for a, k in zip(args, self.args) if k == ROWS]
        if self.native:
            return self.native(df, *args)
        func, kinds, schema = self.func, self.args, self.schema
        name = schema.split()[0]

        def partial(frames):
            for f in frames:
                given = [f[a] if k == ROWS else a for a, k in zip(args, kinds)]
                out = func(*given)
                yield pd.DataFrame({name: list(out) if self_returns == DISTINCT else [out]})

        self_returns = self.returns
        parts = df.select(*columns).mapInPandas(partial, schema)
        return parts.distinct() if self.returns == DISTINCT else parts.agg(F.sum(name).alias(name))

    def merge(self, df: DataFrame, *fixed) -> DataFrame:
        """split, func and combine of the registered Partitioning: partials merged in each partition as they come, then in a tree."""
        from ..operators.aggregate import combined

        func, how = self.func, self.partitioning

        def final(frame: pd.DataFrame) -> pd.DataFrame:
            return how.combine([frame.iloc[[k]].reset_index(drop=True) for k in range(len(frame))])

        def partial(frames):
            merged = None
            for part in how.split(frames):
                new = func(part, *fixed)
                merged = new if merged is None else how.combine([merged, new])
            if merged is not None:
                yield merged

        return combined(df.mapInPandas(partial, self.schema), final)

    def apply(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """The function over each whole group; rows without a key are left out."""
        from ..operators.aggregate import group_apply

        return group_apply(df, keys, self.func, self.schema)

    def batches(self, df: DataFrame, *fixed) -> DataFrame:
        """The function over the frames of each partition, every row once."""
        func, how = self.func, self.partitioning

        def run(frames):
            for part in how.split(frames):
                yield func(part, *fixed)

        return df.mapInPandas(run, self.schema)


REGISTRY: dict[str, Registered] = {}


def splittable(args: tuple[str, ...], returns: str = ROWS, schema: str | None = None, native: Callable | None = None, partitioning: Partitioning | None = None, name: str | None = None):
    """Decorator. Arguments with defaults that args leaves out are whole; any other mismatch is an error at once."""

    def register(func: Callable) -> Registered:
        params = list(inspect.signature(func).parameters.values())
        kinds = list(args)
        for p in params[len(kinds) :]:
            if p.default is inspect.Parameter.empty:
                raise ValueError(f"argument {p.name} of {func.__name__} has no kind")
            kinds.append(WHOLE)
        if len(kinds) > len(params):
            raise ValueError(f"{func.__name__} takes {len(params)} arguments, not {len(kinds)}")
        for k in [*kinds, returns]:
            if k not in KINDS:
                raise ValueError(f"unknown kind {k!r}")
        if native is None and schema is None:
            raise ValueError("a function without a native form needs a result schema")
        out = Registered(func, tuple(kinds), returns, schema, native, partitioning or Partitioning())
        REGISTRY[name or func.__name__] = out
        return out

    return register
