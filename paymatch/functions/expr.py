"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column, table: dict, default=None, as_type: str = "string") -> Column:
    """A constant mapping as a CASE chain, which stays inside generated code."""
    out = None
    for k, v in table.items():
        value = F.lit(v).cast(as_type)
        out = F.when(key == k, value) if out is None else out.when(key == k, value)
    return out.otherwise(F.lit(default).cast(as_type))


def flags(*pairs) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label) if isinstance(label, str) else label)
                                     for label, cond in pairs]))


def half_up(x: Column, digits: int) -> Column:
    """floor(x*10^d + 0.5) / 10^d on doubles: the same IEEE steps in every engine."""
    scale = float(10 ** digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def true(c: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(c, F.lit(False))


def joined(c: Column, sep: str = ",") -> Column:
    return F.array_join(c, sep)
