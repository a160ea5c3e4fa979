"""Column functions on prices, probabilities and labels. Nulls give nulls; NaN counts as null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SELL, HOLD, BUY = 0, 1, 2
LABELS = ("Sell", "Hold", "Buy")
FLOOR = 1e-12


def no_nan(x: Column) -> Column:
    """Null for NaN: in Spark NaN is a value above all others."""
    return F.when(~F.isnan(x), x)


def floored(x: Column) -> Column:
    """At least ``FLOOR``; null stays null, which ``greatest`` alone would skip."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(FLOOR)))


def log_price(x: Column) -> Column:
    return F.log(floored(x))


def both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def label_id(label: Column) -> Column:
    return reduce(lambda rest, k: F.when(label == LABELS[k], k).otherwise(rest), (BUY, HOLD, SELL), F.lit(None).cast("int"))


def label_name(label: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), label + 1)


def one_hot(label: Column, classes: int = 3) -> Column:
    return F.array(*[(label == k).cast("int") for k in range(classes)])


def softmax(logits: list[Column]) -> list[Column]:
    """Probabilities, shifted by the largest logit."""
    top = F.greatest(*logits)
    powers = [F.exp(x - top) for x in logits]
    return [p / reduce(lambda a, b: a + b, powers) for p in powers]


def relu(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def relu_slope(x: Column) -> Column:
    return F.when(x > 0, 1.0).when(x.isNotNull(), 0.0)


def first_largest(values: list[Column]) -> Column:
    """Position of the largest value, the first of equal ones."""
    array = F.array(*values)
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def close_to(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.lit(tolerance) + F.lit(1e-5) * F.abs(b)


def buffered(low: Column, high: Column, buy_buffer: Column, sell_buffer: Column) -> tuple[Column, Column]:
    return low * (1 - buy_buffer), high * (1 + sell_buffer)


def iso_date(text: Column) -> Column:
    """A ``YYYY-MM-DD`` date, or null."""
    return F.try_to_date(text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
