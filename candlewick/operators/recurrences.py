"""Recurrences over a series as windows: exponential averages and capital with fees."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.operators.series import KEYS, series, up_to

@dataclass(frozen=True)
class Smoothing:
    """y[seed] is the mean of the ``length`` values up to row ``seed``; then y = alpha * x + (1 - alpha) * y before."""

    name: str
    value: str
    seed: int
    length: int
    alpha: float


def smooth(df: DataFrame, specs: Sequence[Smoothing], keys: Sequence[str] = KEYS) -> DataFrame:
    """A column for each smoothing; null before its seed and from a null value on.

    A row is the map y -> beta * y + v, and maps compose: round k joins each row's map of the last 2**k rows with the one
    that many rows before, so all rounds look back in the same shuffle and sort. They end where beta**(2**k) is 0 in a
    double, as it is in a row loop.
    """
    df = scanned(placed(df.withColumn("_i", F.row_number().over(series(keys)) - 1), specs, keys), specs, keys)
    return df.withColumns({s.name: F.when((F.col("_i") >= s.seed) & ~broken(s, keys), F.col(s.name)) for s in specs}).drop(*[f"_null_{s.name}" for s in specs])


def placed(df: DataFrame, specs: Sequence[Smoothing], keys: Sequence[str] = KEYS) -> DataFrame:
    """What each row, ``_i`` in its series, adds to a smoothing (0 before the seed), and ``_null_``: a value that counts is
    missing. Warm-up rows before the seed's own may be null (a first difference is)."""
    made = {}
    for s in specs:
        x = F.col(s.value)
        mean = F.avg(x).over(series(keys).rowsBetween(-(s.length - 1), 0))
        made[s.name] = F.coalesce(F.when(F.col("_i") < s.seed, 0.0).when(F.col("_i") == s.seed, mean).otherwise(s.alpha * x), F.lit(0.0))
        made[f"_null_{s.name}"] = x.isNull() & (F.col("_i") > s.seed - s.length)
    return df.withColumns(made)


def broken(s: Smoothing, keys: Sequence[str] = KEYS) -> Column:
    """A value is missing up to this row."""
    return F.coalesce(F.bool_or(f"_null_{s.name}").over(up_to(keys)), F.lit(False))


def scanned(df: DataFrame, specs: Sequence[Smoothing], keys: Sequence[str] = KEYS) -> DataFrame:
    """Running sums in which every row back counts (1 - alpha) times as much, by composing maps over 1, 2, 4, ... rows."""
    back = 1
    while factors := {s.name: (1 - s.alpha) ** back for s in specs if (1 - s.alpha) ** back > 0}:
        df = df.withColumns({name: F.col(name) + F.lit(f) * F.lag(name, back, 0.0).over(series(keys)) for name, f in factors.items()})
        back *= 2
    return df


def capital_after_fees(df: DataFrame, growth: Column, cost: Column, capital: float | Column, keys: Sequence[str] = KEYS, order: str = "date") -> DataFrame:
    """``capital`` after each row of c <- c * growth - cost, and ``dead``: it reached 0, where it stays.

    With P the running product of growth, c = P * (c0 - running sum of cost / P).
    """
    up = up_to(keys, order)
    df = df.withColumns({"_g": growth, "_cost": cost}).withColumn("_p", F.product("_g").over(up))
    paid = F.sum(F.try_divide("_cost", "_p")).over(up)
    start = capital if isinstance(capital, Column) else F.lit(float(capital))
    df = df.withColumn("_c", F.col("_p") * (start - paid))
    fallen = F.col("_c").isNull() | (F.col("_c") <= 0) | (F.col("_p") <= 0)
    df = df.withColumn("dead", F.max(fallen).over(up))
    return df.withColumn("capital", F.when(F.col("dead"), 0.0).otherwise(F.col("_c"))).drop("_g", "_p")
