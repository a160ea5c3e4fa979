"""Series operators over chunks against the same over whole series; tables by ticker; saving."""

import datetime
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from candlewick.operators import backtest, chunks, features, labels
from candlewick.sources import bars as sources

DAY = datetime.datetime(2024, 1, 1)


def panel(spark, sizes=(90, 41, 1, 60), jump=0.2, holes=(), seed=2):
    rng, rows = random.Random(seed), []
    for t, n in enumerate(sizes):
        price = 100.0
        for i in range(n):
            price *= 1 + rng.uniform(-jump, jump)
            rows.append((f"T{t}", DAY + datetime.timedelta(i), None if (t, i) in holes else price))
    df = spark.createDataFrame(rows, "ticker string, date timestamp_ntz, close double").orderBy(F.rand(5)).repartition(6)
    return df.withColumns({"open": F.col("close") * 1.01, "high": F.col("close") * 1.1, "low": F.col("close") * 0.9, "adj_close": F.col("close"), "volume": F.col("close") * 3})


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select("ticker", *columns).collect()), key=str)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(y, float) else y)


def test_rows_are_numbered(spark):
    got = sorted((r["ticker"], r["date"], r["_i"]) for r in chunks.numbered(panel(spark)).collect())
    assert [i for _, _, i in got] == [*range(90), *range(41), 0, *range(60)]


@pytest.mark.parametrize("rows", [1, 7, 30, 1000])
def test_halos(spark, rows):
    df = chunks.in_chunks(chunks.numbered(panel(spark)), rows, back=min(rows, 5), ahead=1)
    assert chunks.own(df, rows).count() == 192
    held = {}
    for r in df.collect():
        held.setdefault((r["ticker"], r["_chunk"]), set()).add(r["_i"])
    for (t, c), own in held.items():
        n = {"T0": 90, "T1": 41, "T2": 1, "T3": 60}[t]
        need = set(range(max(0, c * rows - min(rows, 5)), min(n, (c + 1) * rows + 1)))
        assert own == need or c * rows >= n  # a chunk after the last one has nothing of its own
    with pytest.raises(ValueError):
        chunks.in_chunks(df, 3, back=4)


def test_rolling_features_in_chunks(spark):
    df, names = panel(spark, holes={(0, 20), (1, 5)}), [f for f in features.FEATURES if f not in ("rsi", "macd")]
    close(rows_of(chunks.chunked(df, features.rolling_features, 13, back=13), "date", *names), rows_of(features.rolling_features(df), "date", *names))


@pytest.mark.parametrize("rows", [26, 40, 1000])
def test_all_features_in_chunks(spark, rows):
    df = panel(spark, holes={(0, 60), (1, 5)})
    close(rows_of(chunks.feature_table(df, rows), "date", *features.FEATURES), rows_of(features.feature_table(df), "date", *features.FEATURES))


@pytest.mark.parametrize("rows", [6, 11, 1000])
def test_labels_in_chunks(spark, rows):
    df = panel(spark, holes={(0, 33)})
    assert rows_of(chunks.add_labels(df, 5, rows=rows), "date", "Label_id", "Label") == rows_of(labels.add_labels(df, 5), "date", "Label_id", "Label")


@pytest.mark.parametrize(("rows", "short", "fee", "jump"), [(8, False, 0.0, 0.05), (3, True, 2.0, 0.05), (1000, True, 2.0, 0.05), (3, True, 900.0, 0.2), (8, True, 0.0, 1.5), (3, False, 4000.0, 0.1)])
def test_backtests_in_chunks(spark, rows, short, fee, jump):
    names = ("final_capital", "n_trades", "stopped_early", "pnl")
    df = panel(spark, jump=jump)
    close(rows_of(chunks.backtest(df, 3, fee=fee, short=short, rows=rows), *names), rows_of(backtest.backtest(labels.add_labels(df, 3), fee=fee, short=short), *names))


def test_one_series_fills_many_tasks(spark, tmp_path, request):
    panel(spark, (300,)).write.parquet(str(tmp_path / "b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # of so few rows one task would do
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    df = chunks.chunked(spark.read.parquet(str(tmp_path / "b")), features.rolling_features, 30, back=13)
    plan = df._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Exchange hashpartitioning(ticker" in line]
    assert any("_chunk" in line for line in windows)
    tasks = df.where("williams IS NOT NULL").groupBy(F.spark_partition_id()).agg(F.sum("williams"))
    assert tasks.count() > 1


def test_a_table_by_ticker_needs_no_exchange(spark, tmp_path):
    table = sources.write_bucketed(panel(spark), "by_ticker", 4, str(tmp_path / "t"))
    plan = labels.add_labels(table, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert rows_of(labels.add_labels(table, 5), "date", "Label_id") == rows_of(labels.add_labels(panel(spark), 5), "date", "Label_id")


@pytest.mark.parametrize("fail", ["csv", "parquet", "rename"])
def test_a_failed_save_leaves_what_was_there(spark, tmp_path, monkeypatch, fail):
    df, base = panel(spark, (5,)), str(tmp_path / "bars")
    assert sources.save(df, base, "csv") == f"{base}.csv"

    def broken(*_):
        raise PySparkException("disk full")

    real = sources._rename
    if fail == "rename":
        monkeypatch.setattr(sources, "_rename", lambda spark, old, new: broken() if new.endswith(".parquet") else real(spark, old, new))
    else:
        monkeypatch.setattr(sources, f"write_{fail}", broken)
    with pytest.raises(PySparkException):
        sources.save(df.limit(2), base, "csv" if fail == "csv" else "parquet")
    assert sorted(os.listdir(tmp_path)) == ["bars.csv"] and spark.read.option("header", True).csv(f"{base}.csv").count() == 5
    if fail == "parquet":
        with pytest.warns(UserWarning, match="disk full"):
            assert sources.save(df.limit(3), base) == f"{base}.csv"
        assert spark.read.option("header", True).csv(f"{base}.csv").count() == 3
        monkeypatch.setattr(sources, "write_csv", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sources.save(df, base)


def test_saving_replaces_the_other_format(spark, tmp_path):
    df, base = panel(spark, (50,)), str(tmp_path / "bars")
    for kind in ("csv", "parquet", "csv", "auto"):
        path = sources.save(df, base, kind)
        assert os.listdir(tmp_path) == [os.path.basename(path)]


def test_arrival_out_of_order(spark):
    df = panel(spark, (6, 4)).withColumn("at", F.when(F.dayofmonth("date") == 3, 0).otherwise(F.dayofmonth("date")))
    assert rows_of(sources.order_report(df, "at"), "n_rows", "n_backward") == [("T0", 6, 1), ("T1", 4, 1)]
    assert rows_of(sources.order_report(df, "date"), "n_rows", "n_backward") == [("T0", 6, 0), ("T1", 4, 0)]


def test_smoothing_stays_exact_over_long_flats(spark):
    """Far from the last change both averages have all but vanished; their ratio has not."""
    prices = [100.0, 101.0, 99.0] * 10 + [99.0] * 3000
    df = spark.createDataFrame([("A", DAY + datetime.timedelta(i), p) for i, p in enumerate(prices)], "ticker string, date timestamp_ntz, log_adj_close double")
    got = [r["rsi"] for r in features.oscillators(df).orderBy("date").collect()]
    assert got[-1] == pytest.approx(got[40], rel=1e-9) and got[-1] > 1
