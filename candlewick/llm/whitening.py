"""Whitening of embeddings: rows on the leading components of the distinct vectors, each with unit variance.

The fit list (each distinct vector once) is a table in the shared folder. Sums and the centred covariance are added up in
the tasks and by cells of the matrix, so the driver gets a matrix as large as a vector is long, squared; it finds the
components there (``eigen``) and the tasks project every row with them.

Rows whose vector is null or holds null or non-finite entries get no result. A shorter vector goes on with zeros. Repeated
rows each get their own. A component whose eigenvalue cannot be told from 0 is left out (fewer vectors than components, a
constant table), since nothing can be divided by it; an empty table gives no rows. A null id stays null. Other columns of
the input are not read. ``deviation`` is null where it is beyond a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm import eigen
from candlewick.llm.storage import materialize
from candlewick.llm.vectors import dimensions, packed, unpacked, whole_numbers

COMPONENTS = 16
SCALE, OFFSET = 64.0, 1_000_000
#: Rows that are turned into doubles at a time.
ROWS = 4096


@dataclass
class Whitening:
    """What the tasks need: as large as ``dims`` * components."""

    n: int
    sums: list[int]
    near: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    projection: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part in whole numbers, so nothing cancels."""
        return (x - self.near).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2, exact."""
        away, rest = x - self.near, [s - self.n * int(m) for s, m in zip(self.sums, self.near, strict=True)]
        bound = self.n * int(np.abs(away).max(initial=0)) + max(map(abs, rest), default=0)
        kind = np.int64 if bound**2 * max(1, x.shape[1]) < 2**63 else object
        sums = ((away.astype(kind) * self.n - np.array(rest, kind)) ** 2).sum(1) if len(x) else []
        return [int(s) if s < 2**63 else None for s in sums]


def fit_list(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """Each distinct vector of whole numbers once, packed; repeats go within a batch, then within a task, then by shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = whole_numbers(batch.column(0), dims, SCALE, OFFSET)
            yield pa.RecordBatch.from_arrays([pc.unique(packed(x))], names=["x"])

    return df.select(vector).mapInArrow(pack, "x binary").distinct()


def _added(fitted: DataFrame, dims: int, part, kind: str) -> list:
    """Cells (i, j) of the sum over all tasks of what ``part`` makes of each block of rows; a task sends each cell once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                total = total + part(unpacked(batch.column(0).slice(at, ROWS), dims))
        if isinstance(total, np.ndarray):
            i, j = (a.ravel() for a in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    cells = fitted.mapInArrow(run, f"i int, j int, v {'long' if kind != 'double' else 'double'}")
    return cells.groupBy("i", "j").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()  # as many as ``part`` has cells


def _matrix(cells: list, *shape: int) -> np.ndarray:
    out = np.zeros(shape)
    for r in cells:
        out[r["i"], r["j"]] = r["v"]
    return out


def fit(fitted: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list, with its measured identity error; None where no component has any variance."""
    total = {(r["i"], r["j"]): int(r["v"]) for r in _added(fitted, dims, lambda x: np.stack([np.full(dims, len(x)), x.sum(0)]), "decimal(38,0)")}
    if not total or not total[0, 0]:
        return None
    n, sums = total[0, 0], [total[1, j] for j in range(dims)]
    near = [(2 * s + n) // (2 * n) for s in sums]
    model = Whitening(n, sums, np.array(near, np.int64), np.array([(s - n * m) / n for s, m in zip(sums, near, strict=True)]), np.zeros(0), np.zeros(0), np.zeros((dims, 0)))
    centred = model.centred

    def products(x: np.ndarray) -> np.ndarray:
        y = centred(x)
        return y.T @ y

    covariance = _matrix(_added(fitted, dims, products, "double"), dims, dims) / n
    trace = float(np.trace(covariance))
    if trace <= 0:
        return None
    values, vectors = eigen.leading((covariance + covariance.T) / 2, components)
    told = values > dims * 4 * eigen.EPS * trace
    if not told.any():
        return None
    values, vectors = values[told], vectors[:, told]
    model.values, model.explained, model.projection = values, values / trace, vectors / np.sqrt(values)
    projection, k = model.projection, len(values)

    def whitened(x: np.ndarray) -> np.ndarray:
        z = centred(x) @ projection
        return np.vstack([z.T @ z, z.sum(0)])

    got = _matrix(_added(fitted, dims, whitened, "double"), k + 1, k) / n
    model.identity_error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())
    return model


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row and component: see the module."""
    rows = df.select(id, vector)
    schema = T.StructType([T.StructField(id, df.schema[id].dataType), *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    dims = dimensions(rows, vector)
    model = fit(materialize(fit_list(rows, vector, dims), "fit-list"), dims, components) if dims else None
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    shared, k = df.sparkSession.sparkContext.broadcast(model), len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                held, x = whole_numbers(part.column(1), dims, SCALE, OFFSET)
                made = len(x) * k
                each = pa.array(np.repeat(np.flatnonzero(held), k))
                deviations = pa.array(m.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                columns = [part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(made, m.n)), deviations, pa.array((m.centred(x) @ m.projection).ravel()), pa.array(np.tile(m.explained, len(x))), pa.array(np.full(made, m.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(project, schema)
