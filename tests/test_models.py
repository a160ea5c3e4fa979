"""Views of contexts, synchronous fitting and its state, against numpy."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators import context, fit, score, views
from candlewick.operators.fit import Settings

DAY = datetime.datetime(2024, 1, 1)
NAMES = ("a", "b", "c")


def rows(spark, sizes=(40, 7, 2, 25), parts=4, seed=1):
    rng = random.Random(seed)
    out = []
    for t, n in enumerate(sizes):
        for i in range(n):
            split = "train" if i < n * 0.6 else "val" if i < n * 0.8 else "test"
            out.append((f"T{t}", DAY + datetime.timedelta(i), rng.uniform(1, 2), rng.randrange(3), split, rng.gauss(5, 2), rng.gauss(0, 1), 4.0))
    return spark.createDataFrame(out, "ticker string, date timestamp_ntz, adj_close double, Label_id int, split string, a double, b double, c double").repartition(parts)


def listed(view, part=None):
    """(ticker, date) -> context of a view."""
    contexts = views.read_contexts(view, ("ticker", "date"), part)

    def run(batches):
        import pyarrow as pa

        for x, picked in contexts(batches):
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(list(x))], names=["ticker", "date", "x"])

    found = view.rows.mapInArrow(run, "ticker string, date timestamp_ntz, x array<double>").collect()
    assert len({(r["ticker"], r["date"]) for r in found}) == len(found)
    return {(r["ticker"], r["date"]): r["x"] for r in found}


@pytest.mark.parametrize(("length", "run"), [(1, 65_536), (5, 65_536), (5, 5), (5, 8), (3, 4)])
def test_views_hold_the_same_contexts(spark, length, run):
    df = rows(spark)
    want = {(r["ticker"], r["date"]): r["context"] for r in context.context_windows(df, length, NAMES).collect()}
    view = views.context_view(df, length, NAMES, run=run)
    assert listed(view) == want
    val = {(r["ticker"], r["date"]) for r in df.where("split = 'val'").collect()}
    assert listed(view, "val") == {k: v for k, v in want.items() if k in val}
    assert view.ends().count() == len(want)
    if run < 10:
        assert view.rows.where("ticker = 'T0'").select("_run").distinct().count() == -(-40 // run)
    plan = view.rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ticker" in plan and "_run" in plan.split("Exchange hashpartitioning(")[1].split("]")[0]


def test_views_do_not_depend_on_arrow_batches(spark):
    df = rows(spark)
    whole = listed(views.context_view(df, 5, NAMES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert listed(views.context_view(df, 5, NAMES)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError):
        views.context_view(df, 5, NAMES, run=4)


@pytest.mark.parametrize("length", [1, 4, 9])
def test_moments_equal_those_of_the_vectors(spark, length):
    df = rows(spark)
    for part, of in (("train", df.where("split = 'train'")), (None, df)):
        x = np.array([r["context"] for r in context.context_windows(of, length, NAMES).collect()])
        got = views.position_moments(df, length, NAMES, part=part).orderBy("pos").collect()
        assert [r["pos"] for r in got] == list(range(3 * length))
        std = x.std(0)
        assert np.allclose([r["mean"] for r in got], x.mean(0), atol=1e-12) and np.allclose([r["std"] for r in got], np.where(std < 1e-12, 1, std), atol=1e-12)
    plan = views.position_moments(df, length, NAMES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("posexplode") <= 2  # of sums, not of vectors
    assert views.position_moments(df.where("ticker = 'T2'"), 4, NAMES).count() == 0


def model(spark, parts=4, run=65_536, length=3):
    df = rows(spark, (60, 50, 3, 40), parts)
    view = views.context_view(df, length, NAMES, run=run)
    return views.scaled(view, views.position_moments(df, length, NAMES, part="train"))


def in_numpy(view, settings, epochs, steps):
    """The fit as a loop over all training contexts on one machine."""
    keys = {(r["ticker"], r["date"]): (r["_key"], r["Label_id"]) for r in view.ends("train").collect()}
    found = listed(view, "train")
    order = sorted(found)
    x, y, k = np.array([found[o] for o in order]), np.array([keys[o][1] for o in order]), np.array([keys[o][0] for o in order])
    counts = np.bincount(y, minlength=3)
    weights = len(y) / (3 * np.maximum(counts, 1))
    net = score.Net.start(x.shape[1], settings.hidden, settings.seed)
    for epoch in range(1, epochs + 1):
        batch, mask = fit.batch_of(k, settings, epoch, steps), fit.dropout_mask(k, settings, epoch)
        loss = total = 0.0
        for number in range(steps):
            mine = batch == number
            if not mine.any():
                continue
            a0 = x[mine] @ net.w0 + net.b0
            a = np.maximum(a0, 0) * mask[mine]
            z = a @ net.w1 + net.b1
            p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            w = weights[y[mine]]
            loss, total = loss - (w * np.log(p[np.arange(mine.sum()), y[mine]] + 1e-12)).sum(), total + w.sum()
            d = p.copy()
            d[np.arange(mine.sum()), y[mine]] -= 1
            d *= (w / w.sum())[:, None]
            back = d @ net.w1.T * mask[mine] * (a0 > 0)
            net = score.Net(net.w0 - settings.alpha * x[mine].T @ back, net.b0 - settings.alpha * back.sum(0), net.w1 - settings.alpha * a.T @ d, net.b1 - settings.alpha * d.sum(0))
    return net, loss / total


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_epochs_equal_a_numpy_loop(spark, dropout):
    s, steps = Settings(0.2, 5, dropout, 8), 3
    want, loss = in_numpy(model(spark), s, 2, steps)
    for parts, run in ((1, 65_536), (4, 65_536), (8, 5)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            view = model(spark, parts, run)
            counts = fit.class_counts(view)
            nets = {7: score.Net.start(9, 5, s.seed)}
            for number in (1, 2):
                nets, losses = fit.epoch(view, nets, {7: s}, counts.sum() / (3 * np.maximum(counts, 1)), number, {7: steps})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert losses[7] == pytest.approx(loss, rel=1e-9)
        for a, b in zip(nets[7].parts(), want.parts(), strict=True):
            assert np.abs(a - b).max() < 1e-9


def test_sums_along_a_tree(spark):
    df = spark.createDataFrame([([float(i), 1.0],) for i in range(100)], "sums array<double>").repartition(50)
    assert fit._added(df, 50 * fit.FAN_IN).tolist() == [4950.0, 100.0]
    assert fit._added(df.limit(0), 4) is None


def test_trials_share_steps_and_end_alike(spark):
    view = model(spark)
    both = [Settings(0.1, 4, batch_size=2), Settings(0.1, 4, batch_size=8)]
    many = fit.fit(view, both, epochs=2, width=8)
    for s, got in zip(both, many, strict=True):
        one = fit.fit(view, [s], epochs=2, width=8)[0]
        assert [h["loss"] for h in one.history] == pytest.approx([h["loss"] for h in got.history]) and np.abs(one.net.w0 - got.net.w0).max() < 1e-9


def test_a_broken_off_fit_goes_on(spark, tmp_path, monkeypatch):
    view, trials = model(spark), [Settings(0.1, 4), Settings(0.5, 3, 0.2)]
    whole = fit.fit(view, trials, epochs=5, patience=2)
    done, real = [], fit.epoch

    def dying(view, nets, settings, weights, number, steps):
        if number == 4 and not done:
            done.append(number)
            raise OSError("gone")
        return real(view, nets, settings, weights, number, steps)

    monkeypatch.setattr(fit, "epoch", dying)
    state = str(tmp_path / "state")
    with pytest.raises(OSError):
        fit.fit(view, trials, epochs=5, patience=2, state=state, every=2)
    began = []
    monkeypatch.setattr(fit, "epoch", lambda *a: (began.append(a[4]), real(*a))[1])
    again = fit.fit(view, trials, epochs=5, patience=2, state=state, every=2)
    assert began[0] == 3
    for a, b in zip(whole, again, strict=True):
        assert (a.epoch, a.waited, a.stopped, a.thresholds) == (b.epoch, b.waited, b.stopped, b.thresholds)
        assert [h["loss"] for h in a.history] == pytest.approx([h["loss"] for h in b.history])
        assert all(np.abs(x - y).max() < 1e-9 for x, y in zip(a.net.parts(), b.net.parts(), strict=True))
    other = fit.fit(view, [Settings(0.2, 4)], epochs=1, state=state)  # another search does not take it
    assert len(other[0].history) == 1


def test_one_pass_scores_like_single_ones(spark):
    view = model(spark)
    nets = {k: score.Net.start(9, 4, k) for k in (0, 3)}
    many = score.score_view(view, nets, "test")
    x = listed(view, "test")
    got = {(r["trial"], r["ticker"], r["date"]): (r["p_sell"], r["p_hold"], r["p_buy"]) for r in many.collect()}
    assert len(got) == 2 * len(x)
    for (k, t, d), p in got.items():
        assert p == pytest.approx(nets[k].output(nets[k].hidden(np.array([x[t, d]])))[0])
    df = spark.createDataFrame([([float(i), 1.0 - i], i) for i in range(10)], "context array<double>, i int")
    net = score.Net.start(2, 4, 1)
    for r in score.forward_pass(df, net).collect():
        assert (r["p_sell"], r["p_hold"], r["p_buy"]) == pytest.approx(net.output(net.hidden(np.array([r["context"]])))[0])


def test_nothing_stays_persisted(spark):
    from candlewick.plans import jobs

    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    bars = rows(spark, (200, 180)).select("ticker", "date", F.col("adj_close").alias("close"))
    bars = bars.withColumns({"open": F.col("close") * 1.01, "high": F.col("close") * 1.1, "low": F.col("close") * 0.9, "adj_close": F.col("close"), "volume": F.lit(3)})
    small = {"alpha": (0.1,), "hidden": (3, 4), "do_dropout": (False, True), "dropout_percent": (0.1,), "batch_size": (64,), "context_len": (3,), "window": (5,)}
    assert jobs.search_models(bars, small, epochs=1).count() == 4
    jobs.train_and_evaluate(bars, 5, 3, Settings(0.1, 3), epochs=1)[2].collect()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
