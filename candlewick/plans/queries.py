"""The registered queries: each operator over bars derived from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import numpy as np

from candlewick.functions import scalars
from candlewick.functions.scalars import softmax
from candlewick.operators import backtest, chunks, context, features, grids, labels, metrics, score, split
from candlewick.operators.fit import Settings, class_counts, epoch
from candlewick.operators.views import position_moments
from candlewick.plans import jobs, oracle
from candlewick.sources import bars as sources
from candlewick.sources.derived import bars_brand, bars_calm, bars_walk
from candlewick.sources.scratch import new_path

WINDOW = 20
GRID_WINDOWS, GRID_BUFFERS = (5, 20, 60), (0.0, 0.002)
CONTEXT, CONTEXT_FEATURES = 5, ("body_log", "volume_relatif", "williams")
NET_CONTEXT, NET_HIDDEN, FIT_ALPHA = 3, 4, 0.5
#: Rows of a chunk, so that a series of the given tables has several.
CHUNK = 200
TICKER, BRAND = "click", "Brand#11"
RECORD = ("initial_capital", "model_final_capital", "buy_hold_final_capital", "model_pnl", "buy_hold_pnl", "outperformance")

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _labelled(bars: DataFrame) -> DataFrame:
    return labels.add_labels(bars, WINDOW)


def _logs(bars: DataFrame) -> DataFrame:
    return features.log_prices(features.log_returns(bars))


def _few_features(bars: DataFrame) -> DataFrame:
    return features.candles(features.williams(features.relative_volume(_logs(bars)))).dropna(subset=list(CONTEXT_FEATURES))


def _contexts(bars: DataFrame) -> DataFrame:
    return context.context_windows(_few_features(bars), CONTEXT, CONTEXT_FEATURES).select("ticker", "date", "context")


def _moments(bars: DataFrame) -> DataFrame:
    return position_moments(_few_features(bars), CONTEXT, CONTEXT_FEATURES)


def _weighted(vector: Column | str) -> Column:
    return F.aggregate(F.transform(vector, lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)


def _scored(bars: DataFrame) -> DataFrame:
    """Labelled bars with a fixed score: softmax of three scaled features."""
    p = softmax([300 * (F.col("adj_close") / F.col("open") - 1), 200 * (F.col("high") / F.col("low") - 1), 250 * (F.col("open") / F.col("close") - 1)])
    return _labelled(bars).select("ticker", "date", F.col("Label_id").alias("y_true"), *[F.round(x, 6).alias(n) for x, n in zip(p, ("p_sell", "p_hold", "p_buy"), strict=True)])


def _wide(bars: DataFrame) -> DataFrame:
    """Bars as a vendor delivers them: one column for each ticker and field."""
    tickers = [r["ticker"] for r in bars.select("ticker").distinct().orderBy("ticker").collect()]
    names = {"open": "Open", "high": "High", "low": "Low", "close": "Close", "adj_close": "Adj Close", "volume": "Volume"}
    cells = [F.max(F.when(F.col("ticker") == t, F.col(c))).alias(f"{t}|{n}") for t in tickers for c, n in names.items()]
    return bars.groupBy(F.col("date").alias("Date")).agg(*cells)


def _over(fixture: Callable[[SparkSession, str], DataFrame], run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(fixture(spark, sf_dir))


def _positions(bars: DataFrame, short: bool = True) -> DataFrame:
    return _labelled(bars).withColumn("position", backtest.position("Label_id", short))


def _executed(bars: DataFrame) -> DataFrame:
    return _positions(bars).withColumn("executed", backtest.executed("position"))


def _grid(bars: DataFrame, short: bool) -> DataFrame:
    return rounded(grids.label_grid(bars, short, GRID_WINDOWS, GRID_BUFFERS), 2, "score", "final_capital", "pnl")


def _model_fit(bars: DataFrame) -> DataFrame:
    """Losses of three epochs from the fixed net, a step each over all training contexts, and a part of the fitted weights."""
    view = jobs.model_view(bars, WINDOW, NET_CONTEXT)
    counts = class_counts(view)
    nets, settings, out = {0: fixed_net()}, {0: Settings(FIT_ALPHA, NET_HIDDEN)}, []
    for number in range(1, 4):
        nets, loss = epoch(view, nets, settings, counts.sum() / (3 * np.maximum(counts, 1)), number, {0: 1})
        out.append((number, round(loss[0], 6), *[round(float(w), 6) for w in (nets[0].w0.sum(), nets[0].b0.sum(), nets[0].w1[0, 0], nets[0].b1[2])]))
    view.release()
    return bars.sparkSession.createDataFrame(out, "epoch int, loss double, w0 double, b0 double, w1 double, b1 double")


def fixed_net() -> score.Net:
    """Weights by a formula, so that scores can be compared."""
    n, h = NET_CONTEXT * len(features.FEATURES), NET_HIDDEN
    wave = lambda *shape: np.sin(1.0 + 3 * np.arange(np.prod(shape))).reshape(shape)
    return score.Net(wave(n, h) / 2, wave(h) / 4, wave(h, 3), np.array([0.1, 0.3, -0.1]))


def _model_score(bars: DataFrame) -> DataFrame:
    view, names = jobs.model_view(bars, WINDOW, NET_CONTEXT, keep=False), score.PROBABILITIES
    return rounded(score.score_view(view, {0: fixed_net()}, "test"), 6, *names).select("ticker", "date", *names)


def _net_job(bars: DataFrame, **how) -> DataFrame:
    """Measures and record of a job with the fixed net, in one row."""
    model, measured, record = jobs.evaluate_net(bars, fixed_net(), WINDOW, NET_CONTEXT, **how)
    row = rounded(measured, 8, *measured.columns).crossJoin(rounded(record, 2, *record.columns))  # a row each
    return row.withColumns({"buy_threshold": F.lit(model.thresholds[0]), "sell_threshold": F.lit(model.thresholds[1])})


def _history(bars: DataFrame) -> DataFrame:
    rows = jobs.contexts(bars, WINDOW, NET_CONTEXT)
    return rows.select("ticker", "date", "split", "Label_id", F.round(_weighted("context"), 2).alias("weighted"))


def _ingested(bars: DataFrame) -> DataFrame:
    base = new_path(bars.sparkSession, "ingest")
    jobs.ingest(bars.sparkSession, _wide(bars), base, "1970-01-01", kind="parquet", dimension=bars.select("ticker", "company").distinct())
    return sources.read_bars(bars.sparkSession, f"{base}.parquet").select("ticker", "date", "company", "open", "high", "low", "close", "adj_close", "volume")


def _through_csv(bars: DataFrame) -> DataFrame:
    rows = bars.select("ticker", "date", "open", "high", "low", "close", "volume")
    path = new_path(bars.sparkSession, "csv")
    sources.write_csv(rows, path)
    return bars.sparkSession.read.option("header", True).schema(rows.schema).csv(path)


def _partitioned(bars: DataFrame) -> DataFrame:
    path = new_path(bars.sparkSession, "by-ticker")
    sources.write_parquet(bars, path, by_ticker=True)
    return sources.read_bars(bars.sparkSession, path, ["ticker", "date", "close", "volume"], f"ticker = '{BRAND}'")


def _saved(bars: DataFrame) -> DataFrame:
    path = sources.save(bars, new_path(bars.sparkSession, "bars"))
    kept = bars.sparkSession.read.parquet(path) if path.endswith(".parquet") else bars.sparkSession.read.option("header", True).schema(bars.schema).csv(path)
    return kept.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.sum("volume").alias("volume"), F.max("close").alias("top"))


def _bucketed(bars: DataFrame) -> DataFrame:
    """Labels from a table that lies by ticker: no exchange."""
    name = f"bars_{uuid.uuid4().hex}"
    return _labelled(sources.write_bucketed(bars, name, 8, new_path(bars.sparkSession, name))).select("ticker", "date", "Label_id")


def _default_constituents(bars: DataFrame) -> DataFrame:
    """Bars of the default constituents: each series takes the ticker at its place in the sorted list, and its company."""
    names = sources.constituents(bars.sparkSession).withColumn("place", F.row_number().over(Window.orderBy("ticker")))  # 40 rows
    brands = bars.select("ticker").distinct().withColumn("place", F.row_number().over(Window.orderBy("ticker"))).withColumnRenamed("ticker", "brand")  # a row a series
    renamed = bars.withColumnRenamed("ticker", "brand").join(brands.join(names.select("place", "ticker"), "place"), "brand").drop("brand", "place", "company")
    return sources.with_company(renamed, sources.constituents(bars.sparkSession)).select("ticker", "date", "company", "close")


def _ingest_order(bars: DataFrame) -> DataFrame:
    """Rows that step back in an order of arrival: the given one, with every series' last ten days brought in first."""
    own = Window.partitionBy("ticker").orderBy(F.desc("date"))
    late = bars.withColumn("place", F.row_number().over(own)).withColumn("arrived", F.struct((F.col("place") > 10).alias("late"), "ticker", "date"))
    return sources.order_report(late, "arrived")


def _scalars(bars: DataFrame) -> DataFrame:
    """Label codes, one-hot codes, rectified returns, tolerance tests and dates from text of each bar."""
    df = _labelled(bars).withColumn("change", F.col("close") / F.col("open") - 1)
    text = F.date_format("date", "yyyy-MM-dd")
    return df.select(
        "ticker", "date", scalars.label_id(F.col("Label")).alias("label_code"), *[scalars.one_hot(F.col("Label_id"))[k].alias(f"hot_{k}") for k in range(3)],
        F.round(scalars.relu(F.col("change")), 8).alias("gain"), scalars.relu_slope(F.col("change")).alias("slope"), scalars.close_to(F.col("close"), F.col("open"), 5.0).alias("near"),
        scalars.iso_date(text).alias("day"), F.date_add(scalars.iso_date(text), 1).alias("day_after"), scalars.iso_date(F.concat(F.lit("x"), text)).alias("no_day"),
    )


def _some_tickers(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ticker", F.when(F.col("ticker") != BRAND, F.col("ticker")))


def _trial_grid(bars: DataFrame) -> DataFrame:
    small = {"alpha": (1e-2, 1e-3), "hidden": (16,), "do_dropout": (False, True), "dropout_percent": (0.1,), "batch_size": (64,), "context_len": (10,), "window": (20,)}
    return jobs.search_models(bars, small, epochs=2)


def queries() -> dict[str, Query]:
    calm, walk, brand = (lambda run, f=f: _over(f, run) for f in (bars_calm, bars_walk, bars_brand))
    ohlc = lambda b: b.select("ticker", "date", "open", "high", "low", "close", "volume")
    money = lambda d: rounded(d, 2, *[c for c in (*RECORD, "model_capital", "buy_hold_capital", "final_capital", "pnl") if c in d.columns])
    at = lambda *c: lambda d: d.select("ticker", "date", *c)
    feature_digits = lambda d: d.select("ticker", "date", *[F.round(c, 3 if c in ("rsi", "williams") else 7).alias(c) for c in features.FEATURES])
    every_measure = lambda d: rounded(d, 8, *[c for c in d.columns if c != "ticker"])
    tested = lambda b: score.threshold_predict(_scored(b))
    weights = lambda b: context.class_weights(_scored(b).withColumnRenamed("y_true", "Label_id"))
    return {
        "bars_walk": walk(ohlc),
        "bars_brand": brand(ohlc),
        "bars_calm": calm(ohlc),
        "bars_quality": calm(sources.quality_report),
        "prev_extrema": calm(lambda b: at("prev_min", "prev_max")(labels.prev_extrema(b, WINDOW))),
        "raw_labels": calm(lambda b: at("raw_id")(labels.raw_labels(b, WINDOW))),
        "labels": calm(lambda b: at("Label_id", "Label")(_labelled(b))),
        "label_stats": calm(lambda b: labels.label_stats(_labelled(b), ["ticker"])),
        "positions": calm(lambda b: at("position")(_positions(b))),
        "forward_returns": calm(lambda b: at("forward_return", "simple_return")(rounded(b.withColumns({"forward_return": backtest.forward_return("adj_close"), "simple_return": backtest.simple_return("adj_close")}), 8, "forward_return", "simple_return"))),
        "strategy_curve": walk(lambda b: at("model_capital")(money(backtest.curves(_labelled(b))))),
        "buy_hold_curve": walk(lambda b: at("buy_hold_capital")(money(backtest.curves(_labelled(b))))),
        "label_pnl_portfolio": calm(lambda b: money(jobs.label_portfolio(b, WINDOW))),
        "benchmark_log": calm(lambda b: rounded(backtest.benchmark_log(b), 4, "benchmark")),
        "benchmark_simple": calm(lambda b: rounded(backtest.benchmark_simple(b), 4, "benchmark")),
        "split_assign": calm(lambda b: at("split")(split.chronological(b))),
        "split_sizes": calm(lambda b: split.chronological(b).groupBy("ticker", "split").agg(F.count("*").alias("n_rows"))),
        "log_returns": calm(lambda b: at(*features.FEATURES[:6])(rounded(features.log_returns(b), 8, *features.FEATURES[:6]))),
        "candle_features": calm(lambda b: at("range_log", "body_log", "upper_wick_log", "lower_wick_log")(rounded(features.candles(_logs(b)), 8, "range_log", "body_log", "upper_wick_log", "lower_wick_log"))),
        "relative_volume": calm(lambda b: at("volume_relatif")(rounded(features.relative_volume(b), 8, "volume_relatif"))),
        "volatility": calm(lambda b: at("volatility_10")(rounded(features.volatility(_logs(b)), 8, "volatility_10"))),
        "williams_r": calm(lambda b: at("williams")(rounded(features.williams(_logs(b)), 3, "williams"))),
        "rsi": calm(lambda b: at("rsi")(rounded(features.oscillators(_logs(b)), 3, "rsi"))),
        "macd": calm(lambda b: at("macd")(rounded(features.oscillators(_logs(b)), 7, "macd"))),
        "feature_table": calm(lambda b: feature_digits(features.complete(features.feature_table(b)))),
        "executed_positions": calm(lambda b: at("executed")(_executed(b))),
        "turnover": calm(lambda b: at("turnover")(_executed(b).withColumn("turnover", backtest.turnover("executed")))),
        "fee_curve": walk(lambda b: at("model_capital")(money(backtest.curves(_labelled(b), short=True, lag=1, fee=2.0)))),
        "strategy_record": calm(lambda b: money(backtest.results(backtest.curves(_labelled(b))))),
        "portfolio_long_short": walk(lambda b: money(backtest.portfolio(_labelled(b), short=True, lag=1, fee=2.0))),
        "predictions_aligned": calm(lambda b: backtest.aligned(b.select("ticker", "date", "close"), tested(b).select("ticker", "date", "y_pred"))),
        "best_thresholds": calm(lambda b: rounded(grids.best_thresholds(_scored(b), ["ticker"]), 8, "macro_f1", "bal_acc")),
        "backtest_long": calm(lambda b: money(backtest.backtest(_labelled(b), fee=2.0))),
        "backtest_long_short": calm(lambda b: money(backtest.backtest(_labelled(b), fee=2.0, short=True))),
        "backtest_bankrupt": brand(lambda b: money(backtest.backtest(_labelled(b), fee=2.0, short=True))),
        "label_grid_long": walk(lambda b: _grid(b, False)),
        "label_grid_long_short": walk(lambda b: _grid(b, True)),
        "label_grid_best": walk(lambda b: grids.best_of(_grid(b, True))),
        "context_windows": calm(lambda b: _contexts(b).select("ticker", "date", F.size("context").alias("size"), F.round(_weighted("context"), 4).alias("weighted"))),
        "feature_moments": calm(lambda b: rounded(_moments(b), 6, "mean", "std")),
        "standardized": calm(lambda b: context.standardized(_contexts(b), _moments(b)).select("ticker", "date", F.round(_weighted("context"), 4).alias("weighted"))),
        "class_weights": calm(lambda b: rounded(weights(b), 8, "weight")),
        "scored_rows": calm(_scored),
        "threshold_predict": calm(lambda b: at("y_pred")(tested(b))),
        "confusion": calm(lambda b: metrics.confusion(tested(b))),
        "metrics": calm(lambda b: every_measure(metrics.evaluate(tested(b), ["ticker"]))),
        "cross_entropy": calm(lambda b: rounded(metrics.cross_entropy(_scored(b), weights(b)), 6, "cross_entropy")),
        "threshold_grid": calm(lambda b: rounded(grids.threshold_grid(_scored(b)), 8, "acc", "bal_acc", "macro_f1").drop("grid_index")),
        "last_n_signals": calm(lambda b: at("adj_close", "is_buy", "is_sell")(jobs.signal_table(b, WINDOW))),
        "wide_to_long": walk(lambda b: sources.wide_to_long(_wide(b)).select("date", "ticker", "open", "high", "low", "close", "adj_close", "volume")),
        "constituents_join": calm(lambda b: at("company")(sources.with_company(b, b.select("ticker", "company").distinct()))),
        "dataset_summary": calm(sources.summary),
        "date_range": calm(lambda b: at("close")(sources.date_range(b, "1996-01-01", "1996-12-31"))),
        "model_fit": calm(_model_fit),
        "model_score": calm(_model_score),
        "trial_grid": walk(_trial_grid),
        "label_grid_full": walk(lambda b: rounded(jobs.search_labels(b, True), 2, "score", "final_capital", "pnl")),
        "label_grid_long_full": walk(lambda b: rounded(jobs.search_labels(b, False), 2, "score", "final_capital", "pnl")),
        "top_cells": walk(lambda b: grids.best_of(_grid(b, True), [], n=20)),
        "train_single_long": walk(lambda b: _net_job(jobs.single_series(b, TICKER))),
        "train_single_long_short": walk(lambda b: _net_job(jobs.single_series(b, TICKER), short=True)),
        "train_multi_long": calm(_net_job),
        "train_multi_long_short": calm(lambda b: _net_job(b, short=True, fee=1.0)),
        "history_contexts": calm(_history),
        "ticker_filter": calm(lambda b: ohlc(jobs.single_series(b, BRAND))),
        "null_tickers_dropped": calm(lambda b: money(jobs.label_portfolio(_some_tickers(b), WINDOW))),
        "text_dates": calm(lambda b: money(jobs.label_portfolio(b.withColumn("date", F.col("date").cast("string")), WINDOW))),
        "scalars": calm(_scalars),
        "ingest": walk(_ingested),
        "csv_round_trip": calm(_through_csv),
        "partitioned_scan": calm(_partitioned),
        "save_auto": calm(_saved),
        "labels_chunked": calm(lambda b: at("Label_id", "Label")(chunks.add_labels(b, WINDOW, rows=CHUNK))),
        "features_chunked": calm(lambda b: feature_digits(features.complete(chunks.feature_table(b, CHUNK)))),
        "backtest_chunked": calm(lambda b: money(chunks.backtest(b, WINDOW, fee=2.0, short=True, rows=CHUNK))),
        "bankrupt_chunked": brand(lambda b: money(chunks.backtest(b, WINDOW, fee=2.0, short=True, rows=CHUNK))),
        "labels_bucketed": calm(_bucketed),
        "constituents": calm(_default_constituents),
        "ingest_order": calm(_ingest_order),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql(GRID_WINDOWS, GRID_BUFFERS, fixed_net(), NET_CONTEXT, TICKER, BRAND, FIT_ALPHA)
