"""Returns, positions and capital of label signals.

``lag`` 0 lets a signal earn from its own bar to the next; 1 executes it a bar later. ``short`` sells to -1, else to 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.scalars import BUY, SELL
from candlewick.operators.features import log_returns
from candlewick.operators.recurrences import capital_after_fees
from candlewick.operators.series import KEYS, before, series, up_to


def simple_return(price: str, keys: Sequence[str] = KEYS) -> Column:
    """From the bar before; 0 on the first bar, around null prices and from a price of 0."""
    return F.coalesce(F.try_divide(F.col(price), F.lag(price).over(series(keys))) - 1, F.lit(0.0))


def forward_return(price: str, keys: Sequence[str] = KEYS) -> Column:
    """To the next bar; 0 on the last bar and around null prices."""
    return F.coalesce(F.try_divide(F.lead(price).over(series(keys)), F.col(price)) - 1, F.lit(0.0))


def position(signal: str, short: bool = False, keys: Sequence[str] = KEYS) -> Column:
    """Buy to 1, Sell to 0 or -1, Hold keeps; 0 before the first signal."""
    code = F.when(F.col(signal) == BUY, 1).when(F.col(signal) == SELL, -1 if short else 0)
    return F.coalesce(F.last(code, ignorenulls=True).over(up_to(keys)), F.lit(0))


def executed(position: str, keys: Sequence[str] = KEYS) -> Column:
    return F.coalesce(F.lag(position).over(series(keys)), F.lit(0))


def turnover(position: str, keys: Sequence[str] = KEYS) -> Column:
    return F.abs(F.col(position) - F.coalesce(F.lag(position).over(series(keys)), F.lit(0)))


def curves(df: DataFrame, signal: str = "Label_id", price: str = "adj_close", capital: float | Column = 10_000.0, short: bool = False, lag: int = 0, fee: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each bar's forward_return, position, turnover, capital after it (``model_capital``) and buy-and-hold's."""
    if fee < 0:
        raise ValueError("a fee is not negative")
    df = df.withColumns({"forward_return": forward_return(price, keys), "target": position(signal, short, keys)})
    df = df.withColumn("position", executed("target", keys) if lag else F.col("target")).withColumn("turnover", turnover("position", keys))
    growth = 1 + F.col("position") * F.col("forward_return")
    start = capital if isinstance(capital, Column) else F.lit(float(capital))
    up = up_to(keys)
    df = df.withColumn("buy_hold_capital", start * F.product(1 + F.col("forward_return")).over(up))
    if fee or short:
        return capital_after_fees(df, growth, fee * F.col("turnover"), start, keys).withColumnRenamed("capital", "model_capital").drop("target", "_cost", "_c", "dead")
    return df.withColumn("model_capital", start * F.product(growth).over(up)).drop("target")


def results(curve: DataFrame, capital: float | str = 10_000.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """The strategy record of each series with two bars at least."""
    return _record(_ends(curve, capital, keys).where("n_bars >= 2").drop("n_bars"))


def _ends(curve: DataFrame, capital: float | str, keys: Sequence[str]) -> DataFrame:
    start = F.first(capital) if isinstance(capital, str) else F.lit(float(capital))
    return curve.groupBy(*keys).agg(
        F.count("*").alias("n_bars"),
        start.alias("initial_capital"),
        F.max_by("model_capital", "date").alias("model_final_capital"),
        F.max_by("buy_hold_capital", "date").alias("buy_hold_final_capital"),
    )


def _record(ends: DataFrame) -> DataFrame:
    model, hold, start = (F.col(c) for c in ("model_final_capital", "buy_hold_final_capital", "initial_capital"))
    return ends.withColumns({"model_pnl": model - start, "buy_hold_pnl": hold - start, "outperformance": model - hold})


def portfolio(df: DataFrame, signal: str = "Label_id", price: str = "adj_close", capital: float = 10_000.0, capital_mode: str = "split", by: Sequence[str] = (), **how) -> DataFrame:
    """One record for all tickers, or for each value of ``by`` (each over the same tickers). Each ticker gets an equal share
    of ``capital``, counted over all tickers; those with one bar stay out of all totals. ``capital_mode="full"`` runs every
    ticker on the whole capital but counts the shares."""
    if capital_mode not in ("split", "full"):
        raise ValueError(f"unknown capital mode: {capital_mode}")
    df, unit = df.where("ticker IS NOT NULL"), 1.0
    if how.get("fee"):  # a fee does not scale with capital, so the share must be known before the curve
        unit = float(capital) / (1 if capital_mode == "full" else max(1, df.agg(F.countDistinct("ticker").alias("n")).first()["n"]))
    keys = (*by, *KEYS)
    ends = _ends(curves(df, signal, price, unit, keys=keys, **how), unit, keys)
    used = F.col("n_bars") >= 2
    totals = ends.groupBy(*by).agg(F.count("*").alias("_tickers"), F.count_if(used).alias("_used"), *[F.sum(F.when(used, F.col(c)) / unit).alias(c) for c in ("model_final_capital", "buy_hold_final_capital")])
    share = F.try_divide(F.lit(float(capital)), F.col("_tickers"))
    each = F.lit(float(capital)) if capital_mode == "full" else share
    return _record(totals.select(*by, (share * F.col("_used")).alias("initial_capital"), (each * F.col("model_final_capital")).alias("model_final_capital"), (each * F.col("buy_hold_final_capital")).alias("buy_hold_final_capital")))


def aligned(rows: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """``rows`` with the predictions of the same keys. A row without a prediction, or a prediction without a row, is an
    error when the plan runs: all must be used."""
    both = rows.withColumn("_row", F.lit(True)).join(predictions.withColumn("_made", F.lit(True)), list(keys), "full")
    whole = F.when(F.col("_row") & F.col("_made"), True).otherwise(F.raise_error(F.lit("a row or a prediction has no partner")).cast("boolean"))
    return both.where(whole).drop("_row", "_made")


def benchmark_log(df: DataFrame, capital: float = 10_000.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """capital * exp(sum of log returns) of each series."""
    return log_returns(df, ["adj_close"], keys).groupBy(*keys).agg((capital * F.exp(F.coalesce(F.sum("adj_close_ret"), F.lit(0.0)))).alias("benchmark"))


def benchmark_simple(df: DataFrame, price: str = "adj_close", capital: float = 10_000.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """capital * product of (1 + return) of each series."""
    return df.withColumn("_r", simple_return(price, keys)).groupBy(*keys).agg((capital * F.product(1 + F.col("_r"))).alias("benchmark"))


def backtest(df: DataFrame, signal: str = "Label_id", price: str = "adj_close", capital: float = 10_000.0, fee: float = 0.0, short: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Final capital, pnl, trades and early stop of each series: a bar's return is earned by the position before it, then
    its signal trades for a fee (a flip is two trades). Capital at or under 0 ends the run at 0; the trade that does so
    counts."""
    df = df.withColumns({"_r": simple_return(price, keys), "_pos": position(signal, short, keys)})
    df = df.withColumns({"_held": executed("_pos", keys), "_turn": turnover("_pos", keys)})
    df = capital_after_fees(df, 1 + F.col("_held") * F.col("_r"), fee * F.col("_turn"), capital, keys)
    lived = ~F.coalesce(F.max("dead").over(before(keys)), F.lit(False)) & (F.coalesce(F.col("_c") + F.col("_cost"), F.lit(0.0)) > 0)
    df = df.withColumn("_trades", F.when(lived, F.col("_turn")).otherwise(0))
    ends = df.groupBy(*keys).agg(F.max_by("capital", "date").alias("final_capital"), F.sum("_trades").cast("long").alias("n_trades"), F.max("dead").alias("stopped_early"))
    return ends.withColumn("pnl", F.col("final_capital") - float(capital))
