"""Series operators over chunks, so that one very long series fills many tasks.

A series is cut into chunks of equally many rows. What looks a fixed number of rows around (returns, rolling features,
extrema) runs within chunks that hold a few rows of their neighbours as well: a halo, which goes afterwards. What
looks back without end is handed from chunk to chunk: a chunk is summed up in one row (its last signal, the map that it is
for capital, the ends of its averages), these rows are composed in order, and each chunk starts from what the ones
before it come to. Only those rows, one a chunk, meet in a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.scalars import BUY, HOLD, SELL, label_name
from candlewick.operators.backtest import simple_return
from candlewick.operators.features import AVERAGES, changes, from_averages, rolling_features
from candlewick.operators.labels import raw_labels
from candlewick.operators.recurrences import broken, placed, scanned
from candlewick.operators.series import series
from candlewick.sources.scratch import written

ROWS = 1_000_000
#: What windows within chunks go by.
KEYS = ("ticker", "_chunk")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``_i``, each row's place in its series, without a task that sees a whole series.

    Rows are range-sorted by (ticker, date) and written; places are counted within each piece of a series and moved on by
    the sizes of the pieces before it."""
    dealt = df.repartitionByRange("ticker", "date").withColumn("_piece", F.spark_partition_id())
    pieces = written(dealt, "ranges")  # the pieces are read twice, and must be the same
    sizes = pieces.groupBy("ticker", "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("ticker").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("ticker").alias("_t"), F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = pieces.withColumn("_row", F.row_number().over(Window.partitionBy("ticker", "_piece").orderBy("date")) - 1)
    joined = placed.join(starts, F.col("ticker").eqNullSafe(F.col("_t")) & (F.col("_piece") == F.col("_p")))
    return joined.withColumn("_i", F.col("_start") + F.col("_row")).drop("_piece", "_row", "_t", "_p", "_start")


def in_chunks(df: DataFrame, rows: int = ROWS, back: int = 0, ahead: int = 0) -> DataFrame:
    """Numbered rows with their ``_chunk`` and, where they serve a neighbour as its halo of ``back`` rows before and ``ahead``
    rows after it, again with that one's. ``own`` tells the copies."""
    if rows < 1 or max(back, ahead) > rows:
        raise ValueError("a chunk has a row at least, and as many as a halo")
    at, place = F.floor(F.col("_i") / rows), F.col("_i") % rows
    spread = F.concat(F.array(at), F.when(place >= rows - back, F.array(at + 1)).otherwise(F.array().cast("array<bigint>")), F.when((place < ahead) & (at > 0), F.array(at - 1)).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn("_chunk", F.explode(spread))


def own(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """Each row once: without the halos, which operators must not see as rows of their own."""
    return df.where(F.col("_chunk") == F.floor(F.col("_i") / rows))


def chunked(df: DataFrame, run: Callable[[DataFrame, Sequence[str]], DataFrame], rows: int = ROWS, back: int = 0, ahead: int = 0) -> DataFrame:
    """``run(df, keys)`` over the chunks of each series; it looks ``back`` and ``ahead`` at most. Rows come out once."""
    return own(run(in_chunks(numbered(df), rows, back, ahead), KEYS), rows).drop("_i", "_chunk")


def carried(df: DataFrame, summary: dict[str, Column], compose: dict[str, Column]) -> DataFrame:
    """Rows with what the chunks before theirs come to. ``summary``: aggregates of a chunk; ``compose``: columns over
    ``so_far()``, from the summaries of the chunks before. One row a chunk is shuffled by ticker."""
    sums = df.groupBy(*KEYS).agg(*[c.alias(name) for name, c in summary.items()])
    made = sums.select(F.col("ticker").alias("_t"), F.col("_chunk").alias("_c"), *[c.alias(name) for name, c in compose.items()])
    return df.join(made, F.col("ticker").eqNullSafe(F.col("_t")) & (F.col("_chunk") == F.col("_c"))).drop("_t", "_c")


def so_far(inclusive: bool = False):
    """The chunks of a series before this one."""
    return Window.partitionBy("ticker").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def feature_table(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``features.feature_table`` over chunks.

    An average within a chunk starts from 0; what the chunks before add is their own ends, each less by the rows since. Of a
    chunk that is long enough nothing is left after the next, but the sum is exact for chunks of any size."""
    specs = AVERAGES
    halo = changes(rolling_features(in_chunks(numbered(df), rows, back=max(s.seed for s in specs) + 1), KEYS), KEYS)
    mine = written(scanned(own(placed(halo, specs, KEYS), rows), specs, KEYS), "averages")
    ends = {f"_e{s.name}": F.max_by(s.name, "_i") for s in specs} | {f"_n{s.name}": F.max(f"_null_{s.name}") for s in specs}
    before = {f"_c{s.name}": _folded(F.collect_list(f"_e{s.name}").over(so_far()), (1 - s.alpha) ** rows) for s in specs}
    before |= {f"_b{s.name}": F.coalesce(F.max(f"_n{s.name}").over(so_far()), F.lit(False)) for s in specs}
    out = carried(mine, ends, before)
    since = F.col("_i") - F.col("_chunk") * rows + 1
    known = {s.name: F.when((F.col("_i") >= s.seed) & ~broken(s, KEYS) & ~F.col(f"_b{s.name}"), F.col(s.name) + F.pow(F.lit(1 - s.alpha), since) * F.col(f"_c{s.name}")) for s in specs}
    return from_averages(out.withColumns(known)).drop("_i", "_chunk", *before, *[f"_null_{s.name}" for s in specs])


def _folded(ends: Column, less: float) -> Column:
    return F.aggregate(ends, F.lit(0.0), lambda a, e: a * F.lit(less) + e)


def _last(name: str) -> Column:
    """The latest value of a chunk that is not null."""
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("_i")))


def raw_chunks(df: DataFrame, n: int, price: str = "adj_close", rows: int = ROWS) -> DataFrame:
    """Rows with ``raw_id`` and the return ``_r``, each once and in its chunk; written, since what is carried reads them again."""
    halo = in_chunks(numbered(df), rows, back=n)
    return written(own(raw_labels(halo, n, price, keys=KEYS).withColumn("_r", simple_return(price, KEYS)), rows), "raw")


def signalled(raw: DataFrame, short: bool = False) -> DataFrame:
    """``Label_id`` of rows with ``raw_id``: Hold in place of a signal that repeats the last one before it, in whatever chunk;
    ``_pos``, the position after each row, and ``_held``, the one before it. A repeated signal changes no position, so the last
    raw signal settles all three."""
    df = raw.withColumn("_signal", F.when(F.col("raw_id") != HOLD, F.col("raw_id")))
    df = carried(df, {"_end": _last("_signal")}, {"_before": F.last("_end", ignorenulls=True).over(so_far())})
    within = F.last("_signal", ignorenulls=True).over(series(KEYS).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_before", F.coalesce(within, F.col("_before")))
    code = lambda c: F.when(c == BUY, 1).when(c == SELL, -1 if short else 0).otherwise(0)
    label = F.when(F.col("raw_id").eqNullSafe(F.col("_before")), HOLD).otherwise(F.col("raw_id")).cast("int")
    return df.withColumns({"Label_id": label, "_held": code(F.col("_before")), "_pos": code(F.coalesce("_signal", "_before"))}).drop("_signal", "_before")


def add_labels(df: DataFrame, n: int, price: str = "adj_close", rows: int = ROWS) -> DataFrame:
    """``labels.add_labels`` over chunks."""
    return signalled(raw_chunks(df, n, price, rows)).withColumn("Label", label_name(F.col("Label_id"))).drop("raw_id", "_r", "_held", "_pos", "_i", "_chunk")


def capital_after_fees(df: DataFrame, growth: Column, cost: Column, capital: float) -> DataFrame:
    """``recurrences.capital_after_fees`` over chunks: c <- c * growth - cost, and 0 for good once it is not positive.

    A chunk is the map c -> P * (c - Q) where c > Q, else 0: P is the product of its growths, Q the sum of cost / P so far. Such
    maps compose to one of their kind, (P1 * P2, Q1 + Q2 / P1); a growth of 0 or less, or an unknown one, is dead for any c.
    """
    up = series(KEYS).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_g": growth, "_cost": cost}).withColumn("_p", F.product("_g").over(up))
    df = df.withColumn("_q", F.sum(F.try_divide("_cost", "_p")).over(up)).withColumn("_broke", F.max(F.col("_g").isNull() | F.col("_cost").isNull() | (F.col("_p") <= 0)).over(up))
    ends = {"_P": F.max_by("_p", "_i"), "_Q": F.max_by("_q", "_i"), "_B": F.max("_broke")}
    so, inclusive = so_far(), so_far(True)
    sums = df.groupBy(*KEYS).agg(*[c.alias(n) for n, c in ends.items()])
    sums = sums.withColumn("_Pall", F.product("_P").over(inclusive))
    sums = sums.withColumn("_paid", F.sum(F.try_divide(F.col("_Q") * F.col("_P"), F.col("_Pall"))).over(so))  # Q / P of all chunks before it
    sums = sums.withColumns({"_Pbefore": F.coalesce(F.product("_P").over(so), F.lit(1.0)), "_dead0": F.coalesce(F.max("_B").over(so), F.lit(False)), "_paid": F.coalesce("_paid", F.lit(0.0))})
    start = F.col("_Pbefore") * (F.lit(float(capital)) - F.col("_paid"))
    lost = F.col("_dead0") | start.isNull() | (start <= 0)
    made = sums.select(F.col("ticker").alias("_t"), F.col("_chunk").alias("_c"), F.when(lost, 0.0).otherwise(start).alias("_start"))
    df = df.join(made, F.col("ticker").eqNullSafe(F.col("_t")) & (F.col("_chunk") == F.col("_c"))).drop("_t", "_c")
    df = df.withColumn("_value", F.col("_p") * (F.col("_start") - F.col("_q")))
    df = df.withColumn("dead", F.max((F.col("_start") <= 0) | F.col("_broke") | F.col("_value").isNull() | (F.col("_value") <= 0)).over(up))
    df = df.withColumns({"capital": F.when(F.col("dead"), 0.0).otherwise(F.col("_value")), "_before_cost": F.col("_value") + F.col("_cost")})
    # dead before this row: earlier in the chunk, or at its start
    gone = F.coalesce(F.lag("dead").over(series(KEYS)), F.col("_start") <= 0)
    return df.withColumn("_lived", ~gone & (F.coalesce("_before_cost", F.lit(0.0)) > 0)).drop("_g", "_p", "_q", "_broke", "_start", "_value", "_before_cost")


def backtest(df: DataFrame, n: int, price: str = "adj_close", capital: float = 10_000.0, fee: float = 0.0, short: bool = False, rows: int = ROWS) -> DataFrame:
    """Labels of window ``n`` and their ``backtest.backtest``, all over chunks of ``rows`` rows."""
    held = signalled(raw_chunks(df, n, price, rows), short).withColumn("_turn", F.abs(F.col("_pos") - F.col("_held")))
    run = capital_after_fees(held, 1 + F.col("_held") * F.col("_r"), fee * F.col("_turn"), capital)
    ends = run.groupBy("ticker").agg(F.max_by("capital", "_i").alias("final_capital"), F.sum(F.when(F.col("_lived"), F.col("_turn")).otherwise(0)).cast("long").alias("n_trades"), F.max("dead").alias("stopped_early"))
    return ends.withColumn("pnl", F.col("final_capital") - float(capital))
