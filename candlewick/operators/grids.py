"""Parameter grids, each as one distributed job."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.scalars import BUY, HOLD, SELL
from candlewick.operators.backtest import benchmark_simple, simple_return
from candlewick.operators.labels import raw_label
from candlewick.operators.metrics import evaluate
from candlewick.operators.recurrences import capital_after_fees
from candlewick.operators.score import threshold_predict
from candlewick.operators.series import series, up_to

# The grids searched by default.
WINDOWS_LONG = range(5, 61)
WINDOWS_LONG_SHORT = range(2, 61)
BUFFERS = (0.0, 0.001, 0.002, 0.005)
BUY_THRESHOLDS = (0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85)
SELL_THRESHOLDS = (0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
DEFAULT_THRESHOLDS = (0.75, 0.75)


def label_grid(df: DataFrame, short: bool = False, windows: Sequence[int] | None = None, buffers: Sequence[float] = BUFFERS, price: str = "adj_close", fee: float = 2.0, capital: float = 10_000.0) -> DataFrame:
    """Backtest every (window, buy buffer, sell buffer) on every ticker: final_capital, pnl, n_trades, score against
    buy-and-hold, and ``grid_index``, the place in loop order.

    All windows' extrema come from one frame of the bars before: a sparse table holds the minima and maxima of its windows of
    power-of-two lengths, and any other window is covered by two of them. Only bars with a raw signal are blown up to the grid, and after
    alternation only trades reach the second shuffle: between trades capital moves by exp of a difference of running log
    returns, which do not depend on the parameters.
    """
    windows = list(windows or (WINDOWS_LONG_SHORT if short else WINDOWS_LONG))
    keys, w, up, x = ("ticker",), series(), up_to(), F.col(price)
    whole = Window.partitionBy(*keys)
    bars = df.where("ticker IS NOT NULL").select("ticker", "date", x.cast("double").alias(price)).withColumn("r", simple_return(price))
    bars = bars.withColumns({
        "l": F.sum(F.when(F.col("r") > -1, F.log1p("r")).otherwise(0.0)).over(up),
        "s": F.sum(F.when(F.col("r") < 1, F.log1p(-F.col("r"))).otherwise(0.0)).over(up),
        "kl": F.count_if(F.col("r") <= -1).over(up),
        "ks": F.count_if(F.col("r") >= 1).over(up),
    })
    now = F.struct("l", "s", "kl", "ks")
    bars = bars.withColumn("end", F.max_by(now, "date").over(whole))
    # a window is full where the last null lies before it: one count serves all windows
    bars = bars.withColumn("_at", F.row_number().over(w))
    bars = bars.withColumn("_valid", F.col("_at") - 1 - F.coalesce(F.max(F.when(x.isNull(), F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bars = bars.withColumn("_past", F.reverse(F.collect_list(x).over(w.rowsBetween(-max(windows), -1))))
    # entry i of table k covers the 2**k values from the i-th on, latest first; a column each, so none is worked out twice
    bars, top = bars.withColumns({"_low0": F.col("_past"), "_high0": F.col("_past")}), max(windows).bit_length() - 1
    for i in range(top):
        later = lambda name, i=i: F.slice(name, 2**i + 1, max(windows))
        bars = bars.withColumns({f"_low{i + 1}": F.zip_with(f"_low{i}", later(f"_low{i}"), lambda a, b: F.least(a, b)), f"_high{i + 1}": F.zip_with(f"_high{i}", later(f"_high{i}"), lambda a, b: F.greatest(a, b))})
    bars = bars.withColumns({f"_{side}": F.array(*[f"_{side}{i}" for i in range(top + 1)]) for side in ("low", "high")})
    k = lambda n: (F.length(F.bin(n)) - 1).cast("int")
    listed = F.transform(_numbers(windows, "int"), lambda n: F.struct(n.alias("window"), k(n).alias("k"), (n - F.pow(F.lit(2), k(n)).cast("int")).alias("shift")))
    full = F.filter(listed, lambda c: c["window"] <= F.col("_valid"))
    two = lambda name, least, c: least(F.get(F.get(name, c["k"]), F.lit(0)), F.get(F.get(name, c["k"]), c["shift"]))
    extrema = F.transform(full, lambda c: F.struct(c["window"].alias("window"), two("_low", F.least, c).alias("low"), two("_high", F.greatest, c).alias("high")))
    bars = bars.withColumn("extrema", extrema).select("ticker", "date", price, now.alias("now"), "end", F.inline_outer("extrema"))  # a filter on the array would work it out twice
    # a limit moves one way with its buffer, up or down by the sign of the price: what is no signal under the smallest nor the
    # largest buffer is none under any
    least, most = min(buffers), max(buffers)
    bars = bars.where((x <= F.greatest(F.col("low") * (1 - least), F.col("low") * (1 - most))) | (x >= F.least(F.col("high") * (1 + least), F.col("high") * (1 + most))))
    buffer = _numbers(buffers, "double")
    signals = bars.select("ticker", "date", price, "now", "end", "window", "low", "high", F.explode(buffer).alias("buy_buffer")).select("*", F.explode(buffer).alias("sell_buffer"))
    raw = raw_label(x, F.col("low") * (1 - F.col("buy_buffer")), F.col("high") * (1 + F.col("sell_buffer")))
    signals = signals.withColumn("signal", raw).where(F.col("signal") != HOLD).drop(price, "low", "high")

    cell = ("ticker", "window", "buy_buffer", "sell_buffer")
    own = series(cell)
    before = F.lag("signal").over(own)
    trades = signals.where(F.col("signal").isin(BUY, SELL)).withColumn("before", before).where(~F.col("signal").eqNullSafe(F.col("before")))
    target = lambda c: F.when(c == BUY, 1).when(c == SELL, -1 if short else 0).otherwise(0)
    trades = trades.withColumns({"pos": target(F.col("signal")), "held": F.coalesce(target(F.col("before")), F.lit(0))})
    trades = trades.withColumns({"turn": F.abs(F.col("pos") - F.col("held")), "last": F.lag("now").over(own), "final": F.lead("date").over(own).isNull()})
    trades = trades.withColumn("moved", _moved(F.col("held"), F.col("last"), F.col("now")))
    trades = capital_after_fees(trades, F.col("moved"), fee * F.col("turn"), capital, cell)
    # a run that a return ended since the last trade does not make this one
    alive = ~F.coalesce(F.max("dead").over(series(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)) & (F.col("moved") > 0) & (F.coalesce(F.col("_c") + F.col("_cost"), F.lit(0.0)) > 0)
    closing = F.col("capital") * _moved(F.col("pos"), F.col("now"), F.col("end"))
    ends = trades.withColumn("_t", F.when(alive, F.col("turn")).otherwise(0)).groupBy(*cell).agg(F.max(F.when(F.col("final"), F.greatest(closing, F.lit(0.0)))).alias("_final"), F.sum("_t").cast("long").alias("_trades"))

    hold = benchmark_simple(df.where("ticker IS NOT NULL"), price, capital)
    cells = hold.select("ticker", "benchmark", F.posexplode(_numbers(windows, "int")).alias("_w", "window")).select("*", F.posexplode(buffer).alias("_b", "buy_buffer")).select("*", F.posexplode(buffer).alias("_s", "sell_buffer"))
    cells = cells.withColumn("grid_index", (F.col("_w") * len(buffers) + F.col("_b")) * len(buffers) + F.col("_s"))
    out = cells.join(ends, list(cell), "left").withColumn("final_capital", F.coalesce("_final", F.lit(float(capital))))
    return out.select("ticker", "grid_index", "window", "buy_buffer", "sell_buffer", (F.col("final_capital") - F.col("benchmark")).alias("score"), "final_capital", (F.col("final_capital") - float(capital)).alias("pnl"), F.coalesce("_trades", F.lit(0)).cast("long").alias("n_trades"))


def _numbers(values: Sequence[float], kind: str) -> Column:
    """An array literal in one piece: a call for each element makes large grids slow to plan."""
    return F.expr(f"array({', '.join(f'CAST({v!r} AS {kind})' for v in values)})")


def _moved(held: Column, since: Column, now: Column) -> Column:
    """Growth of a position between two bars; 0 where a return in between wipes it out."""
    long = F.when(now["kl"] > since["kl"], 0.0).otherwise(F.exp(now["l"] - since["l"]))
    short = F.when(now["ks"] > since["ks"], 0.0).otherwise(F.exp(now["s"] - since["s"]))
    return F.when(held == 1, long).when(held == -1, short).otherwise(1.0)


def best_of(grid: DataFrame, by: Sequence[str] = ("ticker",), score: str = "score", index: str = "grid_index", n: int = 1) -> DataFrame:
    """The ``n`` best rows of each group, or of all; of equal scores the earlier in loop order."""
    if not by:
        return grid.orderBy(F.desc(score), index, *[c for c in ("ticker",) if c in grid.columns]).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), index))
    return grid.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def threshold_grid(scored: DataFrame, buys: Sequence[float] = BUY_THRESHOLDS, sells: Sequence[float] = SELL_THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    """Measures of the thresholded predictions for each pair; ``grid_index`` is the place in loop order.

    A row's prediction depends on its argmax and that one probability alone, so rows are counted by class, true class and
    probability bin between thresholds first; the grid then runs over those few counts.
    """
    best = F.greatest("p_sell", "p_hold", "p_buy")
    kind = F.when(F.col("p_sell") == best, 0).when(F.col("p_hold") == best, 1).otherwise(2)
    level = lambda p, cuts: sum(((p >= c).cast("int") for c in cuts), F.lit(0))
    bins = scored.select(*by, "y_true", kind.alias("kind"), F.when(kind == 2, level(F.col("p_buy"), buys)).when(kind == 0, level(F.col("p_sell"), sells)).otherwise(0).alias("level"))
    counted = bins.groupBy(*by, "y_true", "kind", "level").agg(F.count("*").alias("rows"))
    pairs = F.array(*[F.struct(F.lit(i).alias("grid_index"), F.lit(b).alias("buy_threshold"), F.lit(s).alias("sell_threshold"), F.lit(sum(x <= b for x in buys)).alias("_b"), F.lit(sum(x <= s for x in sells)).alias("_s")) for i, (b, s) in enumerate(product(buys, sells))])
    rows = counted.select("*", F.inline(pairs))
    pred = F.when((F.col("kind") == 2) & (F.col("level") >= F.col("_b")), 2).when((F.col("kind") == 0) & (F.col("level") >= F.col("_s")), 0).otherwise(1)
    single = rows.withColumn("y_pred", pred).groupBy(*by, "grid_index", "buy_threshold", "sell_threshold", "y_true", "y_pred").agg(F.sum("rows").alias("rows"))
    return _evaluate_counts(single, [*by, "grid_index", "buy_threshold", "sell_threshold"])


def _evaluate_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    t, p, n = F.col("y_true"), F.col("y_pred"), F.col("rows")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    sums = [total(F.lit(True)).alias("n"), total(t == p).alias("r")]
    for k in range(3):
        sums += [total((t == k) & (p == k)).alias(f"tp{k}"), total(p == k).alias(f"p{k}"), total(t == k).alias(f"t{k}")]
    found = counts.groupBy(*by).agg(*sums)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    f1 = [F.when(share(f"tp{k}", f"p{k}") + share(f"tp{k}", f"t{k}") > 0, 2 * share(f"tp{k}", f"p{k}") * share(f"tp{k}", f"t{k}") / (share(f"tp{k}", f"p{k}") + share(f"tp{k}", f"t{k}"))).otherwise(0.0) for k in range(3)]
    return found.select(*by, (F.col("r") / F.col("n")).alias("acc"), ((share("tp0", "t0") + share("tp1", "t1") + share("tp2", "t2")) / 3).alias("bal_acc"), ((f1[0] + f1[1] + f1[2]) / 3).alias("macro_f1"))


def best_thresholds(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return best_of(threshold_grid(scored, by=by), by, "macro_f1").select(*by, "buy_threshold", "sell_threshold", "macro_f1", "bal_acc")


def evaluate_with(scored: DataFrame, buy: float, sell: float, by: Sequence[str] = ()) -> DataFrame:
    return evaluate(threshold_predict(scored, buy, sell), by)
