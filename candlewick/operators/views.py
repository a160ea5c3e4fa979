"""Contexts as views: ordered feature rows, from which each task makes its context vectors as it reads.

A context table holds every row ``length`` times over; a view holds it once (and the ``length - 1`` rows before a run's first
again). A series is cut into runs of ``RUN`` rows, so that a long one fills many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators.features import FEATURES
from candlewick.operators.series import KEYS, series

RUN = 65_536
#: Contexts that are made at a time.
BLOCK = 1024
PARTS = ("train", "val", "test")


@dataclass(frozen=True)
class View:
    """``rows``: in runs, ordered; ``_x`` the features, ``_at`` the place in the run (no context ends under ``length - 1``),
    ``_key`` a hash of the row's key, and carried columns. ``mean`` and ``std`` scale the positions of a context."""

    rows: DataFrame
    length: int
    width: int
    mean: np.ndarray | None = None
    std: np.ndarray | None = None

    def ends(self, part: str | None = None) -> DataFrame:
        """The rows at which a context ends, each once."""
        kept = self.rows.where(F.col("_at") >= self.length - 1)
        return kept.where(F.col("split") == part) if part else kept

    def release(self) -> None:
        self.rows.unpersist()


def _placed(rows: DataFrame, length: int, keys: Sequence[str], run: int) -> DataFrame:
    """``rows`` with ``_run`` and ``_at``, the last ``length - 1`` rows of a run again before the next one."""
    if run < length:
        raise ValueError("a run is as long as a context at least")
    halo = length - 1
    placed = rows.withColumn("_i", F.row_number().over(series(keys)) - 1)
    own = F.floor(F.col("_i") / run)
    again = F.col("_i") % run >= run - halo
    last = F.max(own).over(Window.partitionBy(*keys))  # the last run has no next one
    runs = F.when(again & (own < F.col("_last")), F.array(own, own + 1)).otherwise(F.array(own))
    copies = placed.withColumn("_last", last).withColumn("_run", F.explode(runs))
    start = F.greatest(F.col("_run") * run - halo, F.lit(0))
    return copies.withColumn("_at", F.col("_i") - start).drop("_last")


def context_view(rows: DataFrame, length: int = 20, features: Sequence[str] = FEATURES, keys: Sequence[str] = KEYS, run: int = RUN, carried: Sequence[str] = ("adj_close", "Label_id", "split")) -> View:
    """Rows of a series in order of date, with what the contexts need. Nothing is copied but at the edges of runs."""
    if length <= 0:
        raise ValueError("a context has a row at least")
    placed = _placed(rows, length, keys, run)
    kept = placed.select(*keys, "date", *carried, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), "_at", "_run", F.xxhash64(*keys, "date").alias("_key"))
    return View(kept.repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", "date"), length, len(features))


def position_moments(rows: DataFrame, length: int, features: Sequence[str] = FEATURES, keys: Sequence[str] = KEYS, part: str | None = None) -> DataFrame:
    """mean and population std of each position of the context vectors that end in ``part`` (the first part, or all rows).

    A position is a feature some rows back. All rows but those next to the edges of a series are in every place of some
    context, so they are summed up once for all places; only the ``length - 1`` rows at either edge are taken place by place.
    """
    halo, w = length - 1, Window.partitionBy(*keys)
    placed = rows.withColumn("_i", F.row_number().over(series(keys)) - 1)
    placed = placed.where(F.col("split") == part) if part else placed
    placed = placed.withColumn("_b", F.max("_i").over(w)).where(F.col("_b") >= halo)
    inner = (F.col("_i") >= halo) & (F.col("_i") <= F.col("_b") - halo)
    figures = [x for f in features for x in (F.avg(F.col(f).cast("double")).alias(f"m_{f}"), F.var_pop(F.col(f).cast("double")).alias(f"v_{f}"))]
    core = placed.where(inner).agg(F.count("*").alias("n"), *figures)
    back = F.explode(F.sequence(F.greatest(F.lit(0), halo - F.col("_i")), F.least(F.lit(halo), F.col("_b") - F.col("_i"))))
    edges = placed.where(~inner).withColumn("_back", back).groupBy("_back").agg(F.count("*").alias("n"), *figures)
    cells = lambda df: F.posexplode(F.array(*[F.struct(F.col(f"m_{f}").alias("m"), F.col(f"v_{f}").alias("v")) for f in features]))
    every = core.withColumn("_back", F.explode(F.sequence(F.lit(0), F.lit(halo)))).unionByName(edges).where("n > 0")
    long = every.select("_back", "n", cells(every).alias("f", "c")).select(((halo - F.col("_back")) * len(features) + F.col("f")).cast("int").alias("pos"), "n", "c.m", "c.v")
    # at most three groups of a position: parallel variances
    total = long.groupBy("pos").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.collect_list(F.struct("n", "m", "v")).alias("g"))
    spread = F.aggregate("g", F.lit(0.0), lambda a, g: a + g["n"] * (g["v"] + (g["m"] - F.col("mean")) * (g["m"] - F.col("mean")))) / F.col("n")
    return total.select("pos", "mean", F.sqrt(spread).alias("std")).withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def scaled(view: View, moments: DataFrame) -> View:
    """The view with the moments of its positions: as many numbers as a context has."""
    found = moments.orderBy("pos").collect()
    if not found:
        return view
    return replace(view, mean=np.array([r["mean"] for r in found]), std=np.array([r["std"] for r in found]))


def read_contexts(view: View, columns: Sequence[str], part: str | None = None):
    """A function for ``mapInArrow`` over ``view.rows``: it yields scaled contexts (a matrix) with the rows they end at, as
    record batches of ``columns``. An Arrow batch and ``length - 1`` rows before it are held at a time."""
    names = view.rows.columns
    length, width, mean, std = view.length, view.width, view.mean, view.std
    at = {c: names.index(c) for c in (*columns, "_x", "_at", "split") if c in names}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
        past = np.zeros((0, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(at["_x"]).flatten(), float).reshape(-1, width)
            place = np.asarray(batch.column(at["_at"]))
            wanted = place >= length - 1
            if part is not None:
                wanted &= np.asarray(batch.column(at["split"]).to_numpy(zero_copy_only=False) == part)
            ends, held = np.flatnonzero(wanted), np.concatenate([past, x])
            whole = np.lib.stride_tricks.sliding_window_view(held, length, axis=0) if len(held) >= length else None
            for a in range(0, len(ends), BLOCK):
                some = ends[a : a + BLOCK]
                made = whole[some + len(past) - length + 1].transpose(0, 2, 1).reshape(len(some), -1)
                picked = pa.RecordBatch.from_arrays([batch.column(at[c]) for c in columns], names=list(columns)).take(pa.array(some))
                yield (made if mean is None else (made - mean) / std), picked
            past = held[max(0, len(held) - length + 1) :]

    return contexts
