"""Technical indicators of a series of bars. Rolling values are null until their frame is full."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.scalars import both, floored, log_price
from candlewick.operators.recurrences import Smoothing, smooth
from candlewick.operators.series import KEYS, full, series

PRICES = ("open", "high", "low", "close", "adj_close")
# The features and their order.
FEATURES = ("open_ret", "high_ret", "low_ret", "close_ret", "adj_close_ret", "volume_ret", "rsi", "macd", "williams", "range_log", "body_log", "upper_wick_log", "lower_wick_log", "volume_relatif", "volatility_10")


def log_returns(df: DataFrame, columns: Sequence[str] = (*PRICES, "volume"), keys: Sequence[str] = KEYS) -> DataFrame:
    """ln of the price ratio to the bar before; volumes: difference of log1p. Absent columns are passed over."""
    w, made = series(keys), {}
    for c in columns:
        if c in df.columns:
            x = F.col(c) if c == "volume" else floored(F.col(c))
            made[f"{c}_ret"] = F.log1p(x) - F.log1p(F.lag(x).over(w)) if c == "volume" else F.log(x / F.lag(x).over(w))
    return df.withColumns(made)


def log_prices(df: DataFrame, columns: Sequence[str] = PRICES) -> DataFrame:
    return df.withColumns({f"log_{c}": log_price(F.col(c)) for c in columns if c in df.columns})


def candles(df: DataFrame) -> DataFrame:
    """Range, body and wicks of the log prices."""
    o, h, low, c = (F.col(f"log_{x}") for x in ("open", "high", "low", "close"))
    return df.withColumns({
        "range_log": h - low,
        "body_log": c - o,
        "upper_wick_log": both(o, c, h - F.greatest(o, c)),
        "lower_wick_log": both(o, c, F.least(o, c) - low),
    })


def relative_volume(df: DataFrame, n: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    frame, v = series(keys).rowsBetween(-(n - 1), 0), F.col("volume")
    return df.withColumn("volume_relatif", F.try_divide(v, full(F.avg(v), frame, v, n)))


def volatility(df: DataFrame, n: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    frame, x = series(keys).rowsBetween(-(n - 1), 0), F.col("adj_close_ret")
    return df.withColumn("volatility_10", full(F.stddev_samp(x), frame, x, n))


def williams(df: DataFrame, n: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    """-100 * (highest high - close) / (highest high - lowest low) of ``n`` bars; 0 where these are equal."""
    frame = series(keys).rowsBetween(-(n - 1), 0)
    top, low = full(F.max("log_high"), frame, F.col("log_high"), n), full(F.min("log_low"), frame, F.col("log_low"), n)
    value = F.when(top == low, 0.0).otherwise(F.try_divide(-100 * (top - F.col("log_close")), top - low))
    return df.withColumn("williams", F.when(F.col("log_close").isNotNull(), value))


#: The averages behind RSI (14, Wilder) and MACD (12, 26).
AVERAGES = (Smoothing("_up", "_gain", 14, 14, 1 / 14), Smoothing("_down", "_loss", 14, 14, 1 / 14), Smoothing("_fast", "_price", 25, 12, 2 / 13), Smoothing("_slow", "_price", 25, 26, 2 / 27))


def changes(df: DataFrame, keys: Sequence[str] = KEYS, x: str = "log_adj_close") -> DataFrame:
    """What the averages are of: ``_gain``, ``_loss`` and ``_price``."""
    change = F.col(x) - F.lag(x).over(series(keys))
    rise = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    return df.withColumns({"_gain": rise(change), "_loss": rise(-change), "_price": F.col(x)})


def from_averages(df: DataFrame) -> DataFrame:
    """``rsi``, and ``macd`` from row 33 on, of rows with ``_i`` and the averages."""
    total = F.col("_up") + F.col("_down")
    rsi = F.when(total == 0, 0.0).otherwise(F.try_divide(100 * F.col("_up"), total))
    made = df.withColumns({"rsi": rsi, "macd": F.when(F.col("_i") >= 33, F.col("_fast") - F.col("_slow"))})
    return made.drop("_gain", "_loss", "_price", "_up", "_down", "_fast", "_slow")


def oscillators(df: DataFrame, keys: Sequence[str] = KEYS, x: str = "log_adj_close") -> DataFrame:
    """``rsi`` and ``macd`` of ``x``."""
    return from_averages(smooth(changes(df, keys, x), AVERAGES, keys)).drop("_i")


def rolling_features(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The features that look back a fixed number of rows: ``williams`` the farthest, 13."""
    df = candles(log_prices(log_returns(df, keys=keys)))
    return volatility(relative_volume(williams(df, keys=keys), keys=keys), keys=keys)


def feature_table(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All ``FEATURES`` of each bar."""
    return oscillators(rolling_features(df, keys), keys)


def complete(df: DataFrame, extra: Sequence[str] = ("Label_id",)) -> DataFrame:
    """Rows that have every feature: warm-up and incomplete ones go."""
    return df.dropna(subset=[*FEATURES, *[c for c in extra if c in df.columns]])
