"""Fitting the net by synchronous gradient steps, and searching its settings.

A step is one Spark job. Every task adds up the gradient of its rows of the step's batch from the same weights, which it
never changes; the sums are added along a tree of tasks and the driver takes the step. Which batch of an epoch a row is in,
and which hidden units it drops, come from a hash of the row's key. So the fitted net depends on the rows and the settings
alone, not on partitions, workers or the size of Arrow batches. Many trials on the same rows share each job. Only weights
and sums travel.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.operators.grids import DEFAULT_THRESHOLDS, best_thresholds
from candlewick.operators.metrics import evaluate
from candlewick.operators.score import Net, score_view, threshold_predict
from candlewick.operators.views import View, read_contexts

#: Sums that one task adds up, and that the driver gets at most.
FAN_IN = 32
#: A step takes ``batch_size`` rows for each of so many streams, so an epoch has rows / (batch_size * WIDTH) jobs.
WIDTH = 32
# The settings searched by default.
TRIALS = {
    "alpha": (1e-3, 1e-4),
    "hidden": (16, 32, 64),
    "do_dropout": (False, True),
    "dropout_percent": (0.1,),
    "batch_size": (32, 64),
    "context_len": (10, 20),
    "window": (10, 20, 30),
}


#: A row of the trial grid.
ROW = "grid_index int, alpha double, hidden int, do_dropout boolean, dropout_percent double, batch_size int, context_len int, window int, model_pnl double, buy_hold_pnl double, outperformance double, score double, macro_f1 double, label_buy long, label_hold long, label_sell long"


@dataclass(frozen=True)
class Settings:
    alpha: float = 1e-3
    hidden: int = 32
    dropout: float = 0.0
    batch_size: int = 32
    seed: int = 42

    def __post_init__(self) -> None:
        if self.alpha <= 0 or self.hidden < 1 or self.batch_size < 1 or not 0 <= self.dropout < 1:
            raise ValueError("alpha, hidden and batch_size are positive, a dropout share lies in [0, 1)")


@dataclass
class Fitted:
    """The best epoch of a trial."""

    net: Net
    thresholds: tuple[float, float] = DEFAULT_THRESHOLDS
    macro_f1: float = -1.0
    bal_acc: float = 0.0
    epoch: int = 0
    waited: int = 0
    stopped: bool = False
    history: list[dict] = field(default_factory=list)


def mixed(x: np.ndarray | int, *more: int) -> np.ndarray:
    """Well-spread 64 bits of a whole number and further ones: a counter-based generator (splitmix64)."""
    z = np.asarray(x).astype(np.uint64)
    with np.errstate(over="ignore"):
        for salt in (0, *more):
            z = z + np.uint64(0x9E3779B97F4A7C15) * np.uint64((2 * salt + 1) % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return z


def batch_of(keys: np.ndarray, s: Settings, epoch: int, steps: int) -> np.ndarray:
    """Which of the epoch's ``steps`` batches each row is in."""
    return (mixed(keys, s.seed, epoch, 1) % np.uint64(steps)).astype(int)


def dropout_mask(keys: np.ndarray, s: Settings, epoch: int) -> np.ndarray:
    """Inverted dropout for each row and hidden unit: 0 with probability ``dropout``, else 1 / (1 - dropout)."""
    units = mixed(mixed(keys, s.seed, epoch, 2)[:, None] ^ mixed(np.arange(s.hidden))[None])
    return ((units >> np.uint64(11)).astype(float) * 2.0**-53 >= s.dropout) / (1 - s.dropout)


def gradient_sums(net: Net, x: np.ndarray, y: np.ndarray, weights: np.ndarray, mask: np.ndarray | float = 1.0) -> tuple[tuple[np.ndarray, ...], float, float]:
    """Sums over rows: class-weighted gradient and cross-entropy, and the weights."""
    a = net.hidden(x) * mask
    p = net.output(a)
    w = weights[y]
    loss = float(-(w * np.log(p[np.arange(len(y)), y] + 1e-12)).sum())
    dz = (p - np.eye(3)[y]) * w[:, None]
    da = (dz @ net.w1.T) * mask * (a > 0)
    return (x.T @ da, da.sum(0), a.T @ dz, dz.sum(0)), loss, float(w.sum())


def gradient(net: Net, x: np.ndarray, y: np.ndarray, weights: np.ndarray, mask: np.ndarray | float = 1.0) -> tuple[tuple[np.ndarray, ...], float]:
    """Of the class-weighted mean cross-entropy of a batch, and the loss."""
    sums, loss, total = gradient_sums(net, x, y, weights, mask)
    return tuple(s / total for s in sums), loss / total


def _flat(net: Net) -> np.ndarray:
    return np.concatenate([p.ravel() for p in net.parts()])


def _shaped(flat: np.ndarray, like: Net) -> Net:
    parts, at = [], 0
    for p in like.parts():
        parts.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    return Net(*parts)


def _added(sums: DataFrame, tasks: int) -> np.ndarray | None:
    """The sum of the vectors of all tasks, in levels of tasks that add up ``FAN_IN`` each; the driver adds the last few."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(0):
                one = np.asarray(v.values)
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": [total]})

    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        sums = sums.repartition(tasks).mapInArrow(add, "sums array<double>")
    got = [np.array(r["sums"]) for r in sums.collect()]
    return sum(got) if got else None


def step(view: View, nets: dict[int, Net], settings: dict[int, Settings], weights: np.ndarray, epoch: int, number: int, steps: dict[int, int]) -> dict[int, tuple[Net, float, float]]:
    """Each net after step ``number`` of an epoch, with the loss and the weight of its batch. One job; nets whose epoch has
    fewer ``steps``, or whose batch is empty, are left out."""
    context = view.rows.sparkSession.sparkContext
    live = {k: net for k, net in nets.items() if number < steps[k]}
    shared = context.broadcast((live, settings, steps))  # the weights alone
    contexts = read_contexts(view, ("Label_id", "_key"), "train")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets, settings, steps = shared.value  # read only: the next task of this worker gets the same objects
        totals = {k: np.zeros(sum(p.size for p in net.parts()) + 2) for k, net in nets.items()}
        seen = False
        for x, rows in contexts(batches):
            y, keys = np.asarray(rows.column(0), int), np.asarray(rows.column(1))
            for k, net in nets.items():
                mine = np.flatnonzero(batch_of(keys, settings[k], epoch, steps[k]) == number)
                if len(mine):
                    mask = dropout_mask(keys[mine], settings[k], epoch) if settings[k].dropout else 1.0
                    parts, loss, total = gradient_sums(net, x[mine], y[mine], weights, mask)
                    totals[k] += np.concatenate([*[p.ravel() for p in parts], [loss, total]])
                    seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({"sums": [np.concatenate(list(totals.values()))]})

    tasks = int(view.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, at, out = _added(view.rows.mapInArrow(run, "sums array<double>"), tasks), 0, {}
    shared.destroy()
    for k, net in live.items() if found is not None else ():
        flat = _flat(net)
        sums, loss, total = found[at : at + flat.size], float(found[at + flat.size]), float(found[at + flat.size + 1])
        at += flat.size + 2
        if total > 0:
            out[k] = _shaped(flat - settings[k].alpha * sums / total, net), loss, total
    return out


def epoch(view: View, nets: dict[int, Net], settings: dict[int, Settings], weights: np.ndarray, number: int, steps: dict[int, int]) -> tuple[dict[int, Net], dict[int, float]]:
    """All nets after one pass over the training contexts, and their class-weighted mean losses on the way."""
    nets, losses, totals = dict(nets), dict.fromkeys(nets, 0.0), dict.fromkeys(nets, 0.0)
    for k in range(max(steps[t] for t in nets)):
        for t, (net, loss, total) in step(view, nets, settings, weights, number, k, steps).items():
            nets[t], losses[t], totals[t] = net, losses[t] + loss, totals[t] + total
    return nets, {t: losses[t] / totals[t] if totals[t] else 0.0 for t in nets}


def better(new: dict, best: Fitted, min_delta: float) -> bool:
    """A larger macro F1 by more than ``min_delta``, or a tie with larger balanced accuracy."""
    tie = abs(new["macro_f1"] - best.macro_f1) <= min_delta + 1e-5 * abs(best.macro_f1)
    return best.epoch == 0 or new["macro_f1"] > best.macro_f1 + min_delta or tie and new["bal_acc"] > best.bal_acc + 1e-12


def class_counts(view: View, part: str | None = "train") -> np.ndarray:
    """Contexts of each class."""
    row = view.ends(part).agg(*[F.count_if(F.col("Label_id") == k).alias(f"c{k}") for k in range(3)]).first()
    return np.array([row[f"c{k}"] for k in range(3)])


def fit(view: View, settings: Sequence[Settings], epochs: int = 500, patience: int = 50, min_delta: float = 1e-4, width: int = WIDTH, state: str | None = None, every: int = 10) -> list[Fitted]:
    """The best epoch of each trial by macro F1 on the validation contexts of a scaled view.

    With ``state``, a folder that the cluster shares, nets, patience and losses are kept there after each ``every`` epochs
    and at the end; a run of the same trials that was broken off goes on from there and ends like a whole one.
    """
    if epochs < 1 or patience < 1 or min_delta < 0 or width < 1 or every < 1:
        raise ValueError("epochs, patience, width and every are 1 at least, min_delta is not negative")
    counts = class_counts(view)
    if not counts.sum():
        raise ValueError("no training rows")
    spark, weights, trials = view.rows.sparkSession, counts.sum() / (3 * np.maximum(counts, 1)), dict(enumerate(settings))
    steps = {k: max(1, int(-(-counts.sum() // (s.batch_size * width)))) for k, s in trials.items()}
    nets = {k: Net.start(view.length * view.width, s.hidden, s.seed) for k, s in trials.items()}
    best, first = {k: Fitted(net) for k, net in nets.items()}, 1
    told = json.dumps([asdict(s) for s in settings] + [width, patience, min_delta])
    if state and (kept := _kept(spark, state, told)):
        first, nets, best = kept
    for number in range(first, epochs + 1):
        live = [k for k, b in best.items() if not b.stopped]
        if not live:
            break
        moved, losses = epoch(view, {k: nets[k] for k in live}, trials, weights, number, steps)
        nets |= moved
        scored = score_view(view, {k: nets[k] for k in live}, "val", ("Label_id",)).withColumnRenamed("Label_id", "y_true")
        found = {r["trial"]: r for r in best_thresholds(scored, ["trial"]).collect()}  # a row a trial
        for k in live:
            b, r = best[k], found.get(k)
            new = {"epoch": number, "loss": losses[k], "macro_f1": r["macro_f1"] if r else 0.0, "bal_acc": r["bal_acc"] if r else 0.0}
            b.history.append(new)
            if better(new, b, min_delta):
                pair = (r["buy_threshold"], r["sell_threshold"]) if r else DEFAULT_THRESHOLDS
                best[k] = replace(b, net=nets[k], thresholds=pair, macro_f1=new["macro_f1"], bal_acc=new["bal_acc"], epoch=number, waited=0)
            else:
                b.waited += 1
                b.stopped = b.waited >= patience
        if state and (number % every == 0 or number == epochs or all(b.stopped for b in best.values())):
            _keep(spark, state, told, number, nets, best)
    return [best[k] for k in trials]


_STATE = "trial int, told string, net array<double>, best array<double>, figures string"


def _keep(spark: SparkSession, state: str, told: str, number: int, nets: dict[int, Net], best: dict[int, Fitted]) -> None:
    """A row a trial; Spark commits the folder of an epoch whole or not at all."""
    figures = lambda b: json.dumps({k: v for k, v in vars(b).items() if k != "net"})
    rows = [(k, told, _flat(nets[k]).tolist(), _flat(b.net).tolist(), figures(b)) for k, b in best.items()]
    spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{state}/epoch={number:06d}")


def _kept(spark: SparkSession, state: str, told: str) -> tuple[int, dict[int, Net], dict[int, Fitted]] | None:
    """Where the last whole epoch of the same trials left off."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    done = sorted((f.getPath().getName() for f in files.listStatus(path) if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))), reverse=True)
    for name in done:
        rows = spark.read.schema(_STATE).parquet(f"{state}/{name}").where(F.col("told") == told).collect()
        if rows:
            nets, best, settings = {}, {}, json.loads(told)
            for r in rows:
                flat, hidden = np.array(r["net"]), settings[r["trial"]]["hidden"]
                inputs = (flat.size - 4 * hidden - 3) // hidden
                like = Net(np.zeros((inputs, hidden)), np.zeros(hidden), np.zeros((hidden, 3)), np.zeros(3))
                nets[r["trial"]] = _shaped(flat, like)
                figures = json.loads(r["figures"])
                best[r["trial"]] = Fitted(_shaped(np.array(r["best"]), like), **figures | {"thresholds": tuple(figures["thresholds"])})
            return int(name.removeprefix("epoch=")) + 1, nets, best
    return None


def evaluated(view: View, net: Net) -> tuple[Fitted, DataFrame, DataFrame]:
    """A given net with the thresholds that suit the validation contexts best, its test predictions and their measures."""
    found = best_thresholds(score_view(view, {0: net}, "val", ("Label_id",)).withColumnRenamed("Label_id", "y_true")).first()
    pair = (found["buy_threshold"], found["sell_threshold"]) if found else DEFAULT_THRESHOLDS
    model = Fitted(net, pair, found["macro_f1"] if found else 0.0, found["bal_acc"] if found else 0.0)
    return model, *test_results(view, [model])


def test_results(view: View, models: Sequence[Fitted]) -> tuple[DataFrame, DataFrame]:
    """Predictions on the test contexts (``Label_id`` predicted, ``y_true``) of every model, by ``trial``, and their measures:
    one pass over the rows for all models."""
    scored = score_view(view, {k: m.net for k, m in enumerate(models)}, "test").withColumnRenamed("Label_id", "y_true")
    of = lambda side: F.element_at(F.array(*[F.lit(float(m.thresholds[side])) for m in models]), F.col("trial").cast("int") + 1)
    predicted = threshold_predict(scored, of(0), of(1))
    return predicted.withColumn("Label_id", F.col("y_pred")), evaluate(predicted, ["trial"])


def trial_grid(variant: Callable[[int, int], View], record: Callable[[DataFrame], DataFrame], grid: dict[str, Sequence] = TRIALS, epochs: int = 500, patience: int = 50, width: int = WIDTH, state: str | None = None) -> DataFrame:
    """Fit every combination of ``grid``; a row for each, with its settings, test measures, profit and label counts.

    ``variant(window, context_len)`` gives the scaled view; ``record(predictions)`` the strategy records by ``trial``. Trials
    on the same variant share rows and jobs. With ``state`` a broken-off search goes on where it was.
    """
    names = list(grid)
    combos = [dict(zip(names, v, strict=True)) for v in product(*grid.values())]
    rows = []
    for window, length in product(grid["window"], grid["context_len"]):
        own = [(k, c) for k, c in enumerate(combos) if c["window"] == window and c["context_len"] == length]
        view = variant(window, length)
        settings = [Settings(c["alpha"], c["hidden"], c["dropout_percent"] if c["do_dropout"] else 0.0, c["batch_size"]) for _, c in own]
        models = fit(view, settings, epochs, patience, width=width, state=f"{state}/{window}-{length}" if state else None)
        counts = class_counts(view, None)
        predicted, measures = test_results(view, models)
        money = {r["trial"]: r for r in record(predicted).collect()}  # a row a trial
        f1 = {r["trial"]: r["macro_f1"] for r in measures.collect()}
        for at, (k, c) in enumerate(own):
            won = {n: money[at][n] for n in ("model_pnl", "buy_hold_pnl", "outperformance")}
            rows.append({"grid_index": k, **c, **won, "score": won["outperformance"], "macro_f1": f1[at], "label_buy": int(counts[2]), "label_hold": int(counts[1]), "label_sell": int(counts[0])})
        view.release()
    return SparkSession.active().createDataFrame(rows, ROW)
