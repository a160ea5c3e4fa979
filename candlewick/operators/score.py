"""Scoring: class probabilities of context vectors by a two-layer net, and thresholded predictions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions.scalars import first_largest
from candlewick.operators.views import View, read_contexts

PROBABILITIES = ("p_sell", "p_hold", "p_buy")
_FIELDS = [T.StructField(n, T.DoubleType()) for n in PROBABILITIES]


@dataclass
class Net:
    """Weights of inputs -> hidden (ReLU) -> sell, hold, buy."""

    w0: np.ndarray
    b0: np.ndarray
    w1: np.ndarray
    b1: np.ndarray

    @staticmethod
    def start(inputs: int, hidden: int, seed: int = 42) -> Net:
        rng = np.random.Generator(np.random.PCG64(seed))
        return Net(rng.normal(0, np.sqrt(2 / inputs), (inputs, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), (hidden, 3)), np.zeros(3))

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.w0 + self.b0)

    def output(self, a: np.ndarray) -> np.ndarray:
        z = a @ self.w1 + self.b1
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.w0, self.b0, self.w1, self.b1


def matrix(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.flatten() if isinstance(vectors, pa.Array) else vectors.combine_chunks().flatten(), float)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def forward_pass(df: DataFrame, net: Net, vector: str = "context") -> DataFrame:
    """Add p_sell, p_hold, p_buy to a table that holds the vectors."""
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(at))
            p = net.output(net.hidden(x)) if len(x) else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_columns(p)], names=[*batch.schema.names, *PROBABILITIES])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *_FIELDS]))


def score_view(view: View, nets: dict[int, Net], part: str, carried: Sequence[str] = ("ticker", "date", "adj_close", "Label_id")) -> DataFrame:
    """trial, the carried columns and p_sell, p_hold, p_buy of each context of ``part`` under every net, in one pass. The nets
    travel with the task: each is as small as its weights."""
    contexts = read_contexts(view, carried, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, rows in contexts(batches):
            for trial, net in nets.items():
                p = net.output(net.hidden(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), trial)), *rows.columns, *_columns(p)], names=["trial", *carried, *PROBABILITIES])

    return view.rows.mapInArrow(run, T.StructType([T.StructField("trial", T.LongType()), *[view.rows.schema[c] for c in carried], *_FIELDS]))


def _columns(p: np.ndarray) -> list[pa.Array]:
    return [pa.array(p[:, k]) for k in range(3)]


def threshold_predict(scored: DataFrame, buy: float | Column = 0.75, sell: float | Column = 0.75) -> DataFrame:
    """``y_pred``: Buy or Sell where it is the most likely class and at or over its threshold, else Hold."""
    best = first_largest([F.col("p_sell"), F.col("p_hold"), F.col("p_buy")])
    return scored.withColumn("y_pred", F.when((best == 2) & (F.col("p_buy") >= buy), 2).when((best == 0) & (F.col("p_sell") >= sell), 0).otherwise(1))
