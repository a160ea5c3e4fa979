"""Named jobs: ingest, train and evaluate, parameter grids, label profit, signal table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.operators import backtest, grids
from candlewick.operators.context import context_windows
from candlewick.operators.features import FEATURES, complete, feature_table
from candlewick.operators.fit import TRIALS, WIDTH, Fitted, Settings, evaluated, fit, test_results, trial_grid
from candlewick.operators.labels import add_labels, last_signals
from candlewick.operators.score import Net
from candlewick.operators.split import chronological
from candlewick.operators.views import View, context_view, position_moments, scaled
from candlewick.sources.bars import coerced_dates, constituents, date_range, normalised, ordered_by_key, require, save, summary, wide_to_long


def ingest(spark: SparkSession, wide: DataFrame, base: str, start: str = "2000-01-01", end: str | None = None, kind: str = "auto", dimension: DataFrame | None = None) -> DataFrame:
    """Land a wide vendor table as bars under ``base``; its summary."""
    long = date_range(wide_to_long(wide), start, end)
    path = save(normalised(long, dimension or constituents(spark)).orderBy("date", "ticker"), base, kind)
    return summary(spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path))


def checked(bars: DataFrame) -> DataFrame:
    """Bars that all jobs start from: the columns are there, rows without a ticker go, text dates become timestamps (one
    that cannot be read is an error), and a (ticker, date) occurs once."""
    bars = require(bars, "ticker", "date", "adj_close").where("ticker IS NOT NULL")
    return ordered_by_key(coerced_dates(bars) if dict(bars.dtypes)["date"] == "string" else bars)


def label_portfolio(bars: DataFrame, window: int = 20, capital: float = 10_000.0) -> DataFrame:
    """Profit of the labels themselves against buy-and-hold, equal capital a ticker."""
    return backtest.portfolio(add_labels(checked(bars), window), capital=capital)


def feature_rows(bars: DataFrame, window: int = 60, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Labelled rows of each ticker with all features and their part. Features run over whole series."""
    return chronological(complete(feature_table(add_labels(checked(bars), window))), train, val)


def contexts(bars: DataFrame, window: int = 60, length: int = 20, train: float = 0.7, val: float = 0.15, features: Sequence[str] = FEATURES) -> DataFrame:
    """Labelled context rows of each ticker with their part. Windows run over whole series, so later parts see the rows
    before them and no part sees later ones."""
    return context_windows(feature_rows(bars, window, train, val), length, features).select("ticker", "date", "adj_close", "Label_id", "split", "context")


def model_view(bars: DataFrame, window: int = 60, length: int = 20, train: float = 0.7, val: float = 0.15, keep: bool = True) -> View:
    """The same contexts as a view, scaled by the moments of the training ones. With ``keep`` it is persisted, since every
    step reads it; ``release`` ends that."""
    rows = feature_rows(bars, window, train, val).select("ticker", "date", "adj_close", "Label_id", "split", *FEATURES)
    rows = rows.persist() if keep else rows
    view = context_view(rows, length)
    view = View(view.rows.persist() if keep else view.rows, view.length, view.width)
    view = scaled(view, position_moments(rows, length, part="train"))
    if keep:
        view.rows.count()  # the view is held from here on, so the rows that it came from can go
        rows.unpersist()
    return view


def train_and_evaluate(bars: DataFrame, window: int = 60, length: int = 20, settings: Settings = Settings(), epochs: int = 500, patience: int = 50, short: bool = False, fee: float = 0.0, capital: float = 10_000.0, capital_mode: str = "split", width: int = WIDTH, state: str | None = None) -> tuple[Fitted, DataFrame, DataFrame]:
    """The fitted model, its test measures, and its portfolio record. Long/short runs execute signals a bar later."""
    view = model_view(bars, window, length)
    return _results(view, fit(view, [settings], epochs, patience, width=width, state=state)[0], short, fee, capital, capital_mode)


def evaluate_net(bars: DataFrame, net: Net, window: int = 60, length: int = 20, short: bool = False, fee: float = 0.0, capital: float = 10_000.0, capital_mode: str = "split") -> tuple[Fitted, DataFrame, DataFrame]:
    """``train_and_evaluate`` with a net that is there already: its thresholds come from the validation rows."""
    view = model_view(bars, window, length)
    return _results(view, evaluated(view, net)[0], short, fee, capital, capital_mode)


def _results(view: View, model: Fitted, short: bool, fee: float, capital: float, capital_mode: str) -> tuple[Fitted, DataFrame, DataFrame]:
    """A row each for measures and record; with them in hand nothing stays persisted."""
    predicted, measures = test_results(view, [model])
    own = lambda df: df.sparkSession.createDataFrame(df.drop("trial").collect(), df.drop("trial").schema)  # noqa: E731  one row
    found = own(measures), own(_profit(predicted, short, fee, capital, capital_mode, ("trial",)))
    view.release()
    return model, *found


def _profit(predicted: DataFrame, short: bool, fee: float, capital: float, capital_mode: str, by: Sequence[str]) -> DataFrame:
    return backtest.portfolio(predicted, capital=capital, capital_mode=capital_mode, by=by, short=short, lag=int(short), fee=fee)


def single_series(bars: DataFrame, ticker: str) -> DataFrame:
    return bars.where(F.col("ticker") == ticker)


def search_models(bars: DataFrame, grid: dict[str, Sequence] = TRIALS, fee: float = 0.0, epochs: int = 500, patience: int = 50, width: int = WIDTH, state: str | None = None) -> DataFrame:
    """All trials of ``grid``, long/short, best profit first among equals by loop order."""
    record = lambda predicted: _profit(predicted, True, fee, 10_000.0, "split", ("trial",))
    return trial_grid(lambda window, length: model_view(bars, window, length), record, grid, epochs, patience, width, state).orderBy(F.desc("score"), "grid_index")


def search_labels(bars: DataFrame, short: bool = False, fee: float = 2.0, capital: float = 10_000.0, part: str | None = "val", **grid) -> DataFrame:
    """Label parameter grid on one part of each series."""
    bars = checked(bars)
    rows = chronological(bars).where(F.col("split") == part) if part else bars
    return grids.label_grid(rows, short, fee=fee, capital=capital, **grid)


def signal_table(bars: DataFrame, window: int = 20, n: int = 160) -> DataFrame:
    return last_signals(add_labels(checked(bars), window), n)
