"""Trend-reversal labels from the extrema of the preceding bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.scalars import BUY, HOLD, LABELS, SELL, label_name
from candlewick.operators.series import KEYS, before, full, series


def prev_extrema(df: DataFrame, n: int, price: str = "adj_close", keys: Sequence[str] = KEYS) -> DataFrame:
    """prev_min and prev_max of the ``n`` bars before each; null until there are that many."""
    frame, x = series(keys).rowsBetween(-n, -1), F.col(price)
    return df.withColumns({"prev_min": full(F.min(x), frame, x, n), "prev_max": full(F.max(x), frame, x, n)})


def raw_label(price: Column, low: Column, high: Column) -> Column:
    """Buy at or under the low (also where both hold), Sell at or over the high, else Hold."""
    return F.when(price <= low, BUY).when(price >= high, SELL).otherwise(HOLD)


def raw_labels(df: DataFrame, n: int, price: str = "adj_close", buy_buffer: float = 0.0, sell_buffer: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    found = prev_extrema(df, n, price, keys)
    low, high = F.col("prev_min") * (1 - buy_buffer), F.col("prev_max") * (1 + sell_buffer)
    return found.withColumn("raw_id", raw_label(F.col(price), low, high)).drop("prev_min", "prev_max")


def alternating(raw: str, keys: Sequence[str] = KEYS) -> Column:
    """Hold in place of a signal that repeats the last one before it."""
    last = F.last(F.when(F.col(raw) != HOLD, F.col(raw)), ignorenulls=True).over(before(keys))
    return F.when(F.col(raw).eqNullSafe(last), HOLD).otherwise(F.col(raw))


def add_labels(df: DataFrame, n: int, price: str = "adj_close", buy_buffer: float = 0.0, sell_buffer: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``Label`` and ``Label_id`` of each bar."""
    raw = raw_labels(df, n, price, buy_buffer, sell_buffer, keys)
    return raw.withColumn("Label_id", alternating("raw_id", keys).cast("int")).drop("raw_id").withColumn("Label", label_name(F.col("Label_id")))


def label_stats(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of each label, zeros kept."""
    counts = [F.count_if(F.col("Label_id") == k).alias(f"n_{LABELS[k].lower()}") for k in (BUY, HOLD, SELL)]
    return labelled.groupBy(*by).agg(*counts)


def last_signals(labelled: DataFrame, n: int = 160, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last ``n`` bars of each series with their Buy and Sell points."""
    place = F.row_number().over(series(keys).orderBy(F.desc("date")))
    return labelled.withColumn("_place", place).where(F.col("_place") <= n).drop("_place").withColumns({"is_buy": F.col("Label_id") == BUY, "is_sell": F.col("Label_id") == SELL})
