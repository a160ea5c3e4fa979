"""Window specifications of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("ticker",)


def series(keys: Sequence[str] = KEYS, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def up_to(keys: Sequence[str] = KEYS, order: str = "date") -> WindowSpec:
    """All rows up to this one."""
    return series(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def before(keys: Sequence[str] = KEYS, order: str = "date") -> WindowSpec:
    """All rows before this one."""
    return series(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def full(value: Column, over: WindowSpec, x: Column, n: int) -> Column:
    """``value`` over a frame of ``n`` rows, null unless all of them have an ``x``."""
    return F.when(F.count(x).over(over) == n, value.over(over))
