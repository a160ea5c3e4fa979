"""Hand cases, properties and plan shapes of the bar operators."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.functions import scalars
from candlewick.operators import backtest, context, features, fit, grids, labels, metrics, score, split, views
from candlewick.plans import jobs
from candlewick.sources import bars as sources

DAY = datetime.datetime(2024, 1, 1)


def frame(spark, prices, ticker="T", **more):
    rows = [(ticker, DAY + datetime.timedelta(i), float(p) if p is not None else None) for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "ticker string, date timestamp_ntz, close double")
    return df.withColumns({"open": F.col("close"), "high": F.col("close"), "low": F.col("close"), "adj_close": F.col("close"), "volume": F.lit(10)})


def column(df, name):
    return [r[name] for r in df.orderBy("ticker", "date").collect()]


def walk(seed, n, jump=0.05):
    rng = random.Random(seed)
    out = [100.0]
    for _ in range(n - 1):
        out.append(out[-1] * (1 + rng.uniform(-jump, jump)))
    return out


def naive_labels(prices, n):
    out, last = [], None
    for i, p in enumerate(prices):
        past = prices[max(0, i - n) : i]
        raw = 1 if len(past) < n else 2 if p <= min(past) else 0 if p >= max(past) else 1
        out.append(1 if raw == last else raw)
        last = raw if raw != 1 else last
    return out


def naive_backtest(prices, signals, fee, capital, short):
    c, pos, trades = capital, 0, 0
    for i, s in enumerate(signals):
        r = prices[i] / prices[i - 1] - 1 if i else 0.0
        c *= 1 + pos * r
        if c <= 0:
            return 0.0, trades, True
        new = 1 if s == 2 else (-1 if short else 0) if s == 0 else pos
        turn = abs(new - pos)
        c, trades, pos = c - fee * turn, trades + turn, new
        if c <= 0:
            return 0.0, trades, True
    return c, trades, False


def test_flat_prices_buy_once(spark):
    got = labels.add_labels(frame(spark, [10] * 30), 5)
    assert column(got, "Label_id") == [1] * 5 + [2] + [1] * 24
    osc = features.oscillators(features.log_prices(frame(spark, [10] * 40)))
    assert column(osc, "rsi")[14:] == [0.0] * 26 and column(osc, "rsi")[:14] == [None] * 14
    assert column(features.williams(features.log_prices(frame(spark, [10] * 20))), "williams")[13:] == [0.0] * 7


def test_rising_and_falling_keep_the_first_signal(spark):
    up = column(labels.add_labels(frame(spark, range(1, 61)), 5), "Label")
    assert up.count("Sell") == 1 and up.count("Buy") == 0
    rsi = column(features.oscillators(features.log_prices(frame(spark, range(1, 61)))), "rsi")
    assert rsi[14:] == pytest.approx([100.0] * 46)


@pytest.mark.parametrize("seed", range(3))
def test_labels_alternate_and_match_a_loop(spark, seed):
    prices = walk(seed, 300)
    got = labels.add_labels(frame(spark, prices), 10)
    ids = column(got, "Label_id")
    assert ids == naive_labels(prices, 10)
    signals = [x for x in ids if x != 1]
    assert all(a != b for a, b in zip(signals, signals[1:]))
    shuffled = labels.add_labels(frame(spark, prices).orderBy(F.rand(7)), 10)
    assert column(shuffled, "Label_id") == ids


@pytest.mark.parametrize(("short", "fee", "jump"), [(False, 2.0, 0.05), (True, 2.0, 0.05), (True, 900.0, 0.2), (True, 0.0, 0.9), (False, 4000.0, 0.1)])
def test_backtest_matches_a_loop(spark, short, fee, jump):
    for seed in range(3):
        prices = walk(seed, 400, jump)
        df = labels.add_labels(frame(spark, prices), 5)
        got = backtest.backtest(df, fee=fee, short=short).first()
        capital, trades, dead = naive_backtest(prices, naive_labels(prices, 5), fee, 10_000.0, short)
        assert got["final_capital"] == pytest.approx(capital, rel=1e-9, abs=1e-6)
        assert (got["n_trades"], got["stopped_early"]) == (trades, dead)


def test_a_tripled_price_ends_a_short(spark):
    df = frame(spark, [10, 9, 10, 30, 5]).withColumn("Label_id", F.when(F.col("close") == 9, 0).otherwise(1))
    got = backtest.backtest(df, short=True).first()
    assert got["final_capital"] == 0 and got["stopped_early"] and got["n_trades"] == 1


def test_grid_equals_single_backtests(spark):
    prices = {t: walk(k, 200, 0.3) for k, t in enumerate("AB")}
    df = frame(spark, prices["A"], "A").unionByName(frame(spark, prices["B"], "B"))
    got = {(r["ticker"], r["window"], r["buy_buffer"], r["sell_buffer"]): r for r in grids.label_grid(df, True, (2, 5), (0.0, 0.01), fee=50.0).collect()}
    assert len(got) == 16
    for (t, n, b, s), r in got.items():
        one = backtest.backtest(labels.add_labels(df.where(F.col("ticker") == t), n, buy_buffer=b, sell_buffer=s), fee=50.0, short=True).first()
        assert r["final_capital"] == pytest.approx(one["final_capital"], rel=1e-9, abs=1e-6) and r["n_trades"] == one["n_trades"]


def loop_of_cell(prices, n, buy, sell, fee, short):
    raw, last = [], None
    for i, p in enumerate(prices):
        past = prices[i - n : i] if i >= n else []
        s = 1 if not past else 2 if p <= min(past) * (1 - buy) else 0 if p >= max(past) * (1 + sell) else 1
        raw.append(1 if s == last else s)
        last = s if s != 1 else last
    return naive_backtest(prices, raw, fee, 10_000.0, short)


@pytest.mark.parametrize("short", [False, True])
def test_grid_below_zero_matches_a_loop(spark, short):
    """Below zero a larger buffer lets more bars signal, and a return can end a run before its next trade."""
    rng, prices, at = random.Random(9), {}, 40.0
    for ticker in "ABC":
        prices[ticker] = [at := at + rng.gauss(-0.3, 6) for _ in range(250)]
    df = frame(spark, prices["A"], "A").unionByName(frame(spark, prices["B"], "B")).unionByName(frame(spark, prices["C"], "C"))
    assert min(prices["A"]) < 0 < max(prices["A"])
    for r in grids.label_grid(df, short, (2, 5), (0.0, 0.02, 0.2)).collect():
        capital, trades, _ = loop_of_cell(prices[r["ticker"]], r["window"], r["buy_buffer"], r["sell_buffer"], 2.0, short)
        assert r["final_capital"] == pytest.approx(capital, rel=1e-9, abs=1e-6) and r["n_trades"] == trades, r


def test_best_takes_the_first_of_equal_scores(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0)], "grid_index int, score double")
    assert grids.best_of(df, []).first()["grid_index"] == 1


def test_no_feature_sees_the_future(spark):
    prices = walk(3, 120)
    whole = features.feature_table(frame(spark, prices)).where(F.col("date") < DAY + datetime.timedelta(90))
    part = features.feature_table(frame(spark, prices[:90]))
    for name in features.FEATURES:
        assert column(whole, name) == pytest.approx(column(part, name), nan_ok=True)
    assert [x is None for x in column(whole, "macd")].index(False) == 33


def test_an_interior_null_ends_the_recursive_indicators(spark):
    prices = walk(4, 100)
    prices[60] = None
    got = features.oscillators(features.log_prices(frame(spark, prices)))
    assert all(x is None for x in column(got, "rsi")[60:]) and column(got, "rsi")[59] is not None
    assert all(x is None for x in column(got, "macd")[60:])


def test_smoothing_across_blocks_matches_a_loop(spark):
    prices = walk(5, 700)
    got = column(features.oscillators(features.log_prices(frame(spark, prices))), "rsi")
    x = np.diff(np.log(prices))
    up, down = np.maximum(x, 0)[:14].mean(), np.maximum(-x, 0)[:14].mean()
    want = [100 * up / (up + down)]
    for v in x[14:]:
        up, down = (13 * up + max(v, 0)) / 14, (13 * down + max(-v, 0)) / 14
        want.append(100 * up / (up + down))
    assert got[14:] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10, 100])
def test_split_sizes(spark, n):
    parts = column(split.chronological(frame(spark, [1] * n)), "split")
    if n < 3:
        assert parts == []
        return
    first = min(max(int(n * 0.7), 1), n - 2)
    second = min(max(int(n * 0.85), first + 1), n - 1)
    assert parts == ["train"] * first + ["val"] * (second - first) + ["test"] * (n - second)


def test_split_rejects_ratios(spark):
    for ratios in ((0, 0.1), (0.9, 0.1), (0.5, 1.2)):
        with pytest.raises(ValueError):
            split.chronological(frame(spark, [1, 2, 3]), *ratios)


def test_portfolio_counts_short_tickers_in_the_share(spark):
    df = frame(spark, [10, 20], "A").unionByName(frame(spark, [5], "B")).withColumn("Label_id", F.lit(2))
    got = backtest.portfolio(df, capital=1000.0).first()
    assert (got["initial_capital"], got["model_final_capital"]) == (500.0, 1000.0)
    full = backtest.portfolio(df, capital=1000.0, capital_mode="full").first()
    assert full["model_final_capital"] == 2000.0
    fee = backtest.portfolio(df, capital=1000.0, fee=10.0).first()
    assert fee["model_final_capital"] == 990.0


def test_context_windows_and_scaling(spark):
    df = frame(spark, range(1, 8)).withColumns({"a": F.col("close"), "b": -F.col("close")})
    got = context.context_windows(df, 3, ("a", "b"))
    assert got.count() == 5
    assert column(got, "context")[0] == [1.0, -1.0, 2.0, -2.0, 3.0, -3.0]
    assert context.context_windows(df, 8, ("a", "b")).count() == 0
    scaled = context.standardized(got, views.position_moments(df, 3, ("a", "b")))
    values = np.array(column(scaled, "context"))
    assert np.allclose(values.mean(0), 0) and np.allclose(values.std(0), 1)


def test_measures_with_empty_classes(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y_true int, y_pred int")
    got = metrics.evaluate(df).first()
    assert got["acc"] == 1 and got["macro_f1"] == pytest.approx(1 / 3) and got["recall_buy"] == 0
    assert [tuple(r) for r in metrics.confusion(df).orderBy("y_true").collect()] == [(0, 0, 0, 0), (1, 0, 2, 0), (2, 0, 0, 0)]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.one_hot(F.lit(2)).alias("hot"), scalars.first_largest([F.lit(0.4), F.lit(0.4), F.lit(0.2)]).alias("best"), scalars.relu(F.lit(-1.0)).alias("relu"), scalars.relu_slope(F.lit(0.0)).alias("slope"),
        scalars.close_to(F.lit(1.0), F.lit(1.00001), 1e-6).alias("close"), scalars.log_price(F.lit(0.0)).alias("log"), scalars.log_price(F.lit(None).cast("double")).alias("null"), scalars.iso_date(F.lit("2024-02-30")).alias("bad"),
        *[p.alias(f"p{k}") for k, p in enumerate(scalars.softmax([F.lit(1000.0), F.lit(1000.0)]))],
    ).first()
    assert (row["hot"], row["best"], row["relu"], row["slope"], row["close"], row["null"], row["bad"]) == ([0, 0, 1], 0, 0.0, 0.0, True, None, None)
    assert row["log"] == pytest.approx(math.log(1e-12)) and row["p0"] == 0.5


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    x, y, weights = rng.normal(size=(12, 6)), rng.integers(0, 3, 12), np.array([1.0, 0.5, 2.0])
    net = score.Net.start(6, 4)
    steps, loss = fit.gradient(net, x, y, weights)
    for k, (part, step) in enumerate(zip(net.parts(), steps, strict=True)):
        at = (0,) * part.ndim
        moved = [p.copy() for p in net.parts()]
        moved[k][at] += 1e-6
        assert (fit.gradient(score.Net(*moved), x, y, weights)[1] - loss) / 1e-6 == pytest.approx(step[at], abs=1e-5)


def test_train_and_evaluate_improves(spark):
    bars = frame(spark, walk(1, 260, 0.03), "A").unionByName(frame(spark, walk(2, 260, 0.03), "B"))
    bars = bars.withColumns({"high": F.col("close") * 1.01, "low": F.col("close") * 0.99})
    model, measures, record = jobs.train_and_evaluate(bars, 5, 3, fit.Settings(0.05, 8), epochs=4, patience=3)
    assert model.epoch >= 1 and model.history[-1]["loss"] < model.history[0]["loss"]
    assert 0 <= measures.first()["macro_f1"] <= 1 and record.count() == 1


def test_ingest_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("2024-01-01", 1.0, 10.0, None, None), ("2024-01-02", 2.0, 20.0, 5.0, None), ("2024-01-03", None, None, None, float("nan"))], "Date string, `A|Close` double, `A|Volume` double, `B|Close` double, `B|Open` double").withColumn("Date", F.to_date("Date"))
    names = spark.createDataFrame([("A", "Alpha"), ("B", "Beta")], "ticker string, company string")
    for kind in ("csv", "parquet", "auto"):
        got = jobs.ingest(spark, wide, str(tmp_path / kind), kind=kind, dimension=names).first()
        assert (got["n_rows"], got["n_tickers"]) == (3, 2)
    long = sources.wide_to_long(wide)
    assert {(r["ticker"], r["close"], r["open"]) for r in long.collect()} == {("A", 1.0, None), ("A", 2.0, None), ("B", 5.0, None)}
    with pytest.raises(Exception, match="no company"):
        sources.with_company(long, names.where("ticker = 'A'")).collect()


def test_partitioned_scan_prunes(spark, tmp_path):
    df = frame(spark, [1, 2], "A").unionByName(frame(spark, [3], "B"))
    sources.write_parquet(df, str(tmp_path / "p"), by_ticker=True)
    got = sources.read_bars(spark, str(tmp_path / "p"), ["ticker", "close"], "ticker = 'B'")
    assert [tuple(r) for r in got.collect()] == [("B", 3.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan and "open" not in plan


def test_constituents_and_ranges(spark):
    assert sources.constituents(spark).count() == 40
    df = frame(spark, [1, 2, 3])
    assert column(sources.date_range(df, "2024-01-01", "2024-01-02"), "close") == [1.0, 2.0]
    for bad in (("2024-1-1", None), ("2024-01-02", "2024-01-01")):
        with pytest.raises(ValueError):
            sources.date_range(df, *bad)
    with pytest.raises(ValueError, match="missing columns: x"):
        sources.require(df, "x")


def test_quality_report_and_key_check(spark):
    df = frame(spark, [1, 2]).unionByName(frame(spark, [1])).unionByName(frame(spark, [1], None))
    got = sources.quality_report(df).first()
    assert (got["n_rows"], got["null_tickers"], got["duplicate_keys"]) == (4, 1, 1)
    with pytest.raises(Exception, match="repeated"):
        sources.ordered_by_key(df).collect()
    assert sources.ordered_by_key(frame(spark, [1, 2])).count() == 2


def test_one_shuffle_for_all_rolling_features(spark, tmp_path):
    frame(spark, walk(1, 50)).write.parquet(str(tmp_path / "b"))
    df = spark.read.parquet(str(tmp_path / "b"))
    rolled = features.volatility(features.relative_volume(features.williams(features.candles(features.log_prices(features.log_returns(df))))))
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_jobs_refuse_repeated_keys_and_unreadable_dates(spark):
    df = frame(spark, walk(1, 30))
    twice = df.unionByName(df.limit(1))
    for job in (jobs.label_portfolio, jobs.signal_table, jobs.search_labels, jobs.contexts):
        with pytest.raises(Exception, match="repeated"):
            job(twice).collect()
        with pytest.raises(ValueError, match="missing columns: adj_close"):
            job(df.drop("adj_close"))
    text = df.withColumn("date", F.col("date").cast("string"))
    assert jobs.label_portfolio(text).collect() == jobs.label_portfolio(df).collect()
    with pytest.raises(Exception, match="cannot be read"):
        jobs.label_portfolio(text.withColumn("date", F.lit("soon"))).collect()
    plan = sources.ordered_by_key(df).withColumn("x", backtest.simple_return("close"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_settings_are_checked(spark):
    for bad in ({"alpha": 0.0}, {"hidden": 0}, {"batch_size": 0}, {"dropout": 1.0}):
        with pytest.raises(ValueError):
            fit.Settings(**bad)
    for bad in ({"epochs": 0}, {"patience": 0}, {"min_delta": -1.0}, {"width": 0}, {"every": 0}):
        with pytest.raises(ValueError):
            fit.fit(None, [fit.Settings()], **bad)


def test_early_stop_matches_a_loop(spark, monkeypatch):
    """The kept epoch and the stop, from given measures an epoch."""
    series = [(0.30, 0.40), (0.50, 0.40), (0.50, 0.45), (0.50004, 0.45), (0.40, 0.90), (0.49, 0.10), (0.60, 0.10), (0.20, 0.20), (0.20, 0.20), (0.20, 0.20), (0.20, 0.20), (0.90, 0.90)]
    calls = iter(series)
    one = spark.createDataFrame([("A", DAY, 1.0, 1, "train", 0.0, 1.0)], "ticker string, date timestamp_ntz, adj_close double, Label_id int, split string, a double, b double")
    view = views.context_view(one, 1, ("a", "b"))
    monkeypatch.setattr(fit, "epoch", lambda view, nets, *_: (nets, dict.fromkeys(nets, 0.0)))

    def scores(*_):
        macro, balanced = next(calls)
        return spark.createDataFrame([(0, 0.75, 0.75, macro, balanced)], "trial int, buy_threshold double, sell_threshold double, macro_f1 double, bal_acc double")

    monkeypatch.setattr(fit, "best_thresholds", scores)
    got = fit.fit(view, [fit.Settings(hidden=2)], epochs=50, patience=4)[0]
    best, kept, waited, ended = None, 0, 0, 0
    for number, (macro, balanced) in enumerate(series, 1):
        tie = best is not None and abs(macro - best[0]) <= 1e-4 + 1e-5 * abs(best[0])
        if best is None or macro > best[0] + 1e-4 or tie and balanced > best[1] + 1e-12:
            best, kept, waited = (macro, balanced), number, 0
        else:
            waited += 1
        ended = number
        if waited == 4:
            break
    assert (got.epoch, got.macro_f1, len(got.history), got.stopped) == (kept, best[0], ended, True) and kept == 7
