"""Exact top-k search by inner product over an impact-ordered index.

Components become whole numbers, floor(256 * x). The rows are dealt to blocks; a block's index has a posting segment for
each (dimension, level), the rows whose component lies in that level. A query takes a block's segments score at a time, by
descending impact (its component times the segment's largest, or smallest, value), and adds the impact to its rows. What a
row may still gain is the sum, over the dimensions, of their largest unprocessed impact, where positive. A query stops
only when the rows whose bound reaches the k-th best exact score so far are few, or all segments are done; all rows whose
bound reaches it are rescored exactly. So no row that belongs to the result can be lost, whatever the vectors are.

A row of whose vector there are k + 1 rows with smaller ids can be in no result, so only the k + 1 smallest ids of a vector
are indexed: a vector that a third of the rows share costs k + 1 rows. The given queries meet all rows by blocks: a task
builds the index of one block and takes queries in as they come.

Vectors that are null or hold null or non-finite components take no part; a shorter one goes on with zeros. Rows of one id
and vector count once; two vectors under one id are two rows. A null id is no query and comes last among ties. An empty
table, or one without a query, gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm.storage import materialize
from candlewick.llm.vectors import dimensions, packed, unpacked, whole_numbers

SCALE = 256.0
LEVELS = 32
#: Rows of a block, and queries that a task takes to it.
BLOCK, GROUP = 16_384, 8_192
#: Shares of a block's postings after which a query looks whether it may stop.
LOOKS = (0.3, 0.4, 0.5, 0.6, 0.75)
#: A query stops where rescoring the rows that may be members reads at most this share of the postings that are left.
RESCORED = 1.0
_NO_ID = np.iinfo(np.int64).max


class ImpactIndex:
    """The index of a block of rows: postings of each dimension by level, with each segment's bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order])
        n, dims = self.x.shape
        self.dims, self.top = dims, int(np.abs(self.x).max(initial=0))
        self.postings, self.starts, self.ends, low, high, of = [], [], [], [], [], []
        for d in range(dims):
            column = self.x[:, d]
            rows = np.argsort(column, kind="stable")
            ordered = column[rows]
            # levels hold as many rows each, but equal values share one
            cuts = np.unique(np.append(np.searchsorted(ordered, ordered[np.arange(levels) * n // levels]), n))
            self.postings.append(rows)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                of.append(d)
                self.starts.append(a)
                self.ends.append(b)
                low.append(ordered[a])
                high.append(ordered[b - 1])
        self.low, self.high, self.of = np.array(low), np.array(high), np.array(of, int)
        self.sizes = np.array(self.ends) - np.array(self.starts)

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ``k`` best rows and their scores; of equal scores the smaller ids."""
        # products that may leave a long are taken as whole numbers of any size, without the index
        big = self.top * max(1, int(np.abs(q).max(initial=0))) * max(1, self.dims) >= 2**62
        kind = object if big else np.int64
        exact = lambda rows: self.x[rows].astype(kind, copy=False) @ q.astype(kind, copy=False)
        n = len(self.ids)
        k = min(k, n)
        if big or n <= 4 * k:
            return self._best(np.arange(n), exact(np.arange(n)), k)
        w = q[self.of]
        impact = np.where(w > 0, w * self.high, w * self.low)
        order = np.argsort(-impact, kind="stable")
        done = np.cumsum(self.sizes[order])
        looks = {int(np.searchsorted(done, share * done[-1])) + 1 for share in LOOKS} | {len(order)}
        total, postings, starts, ends, of = np.zeros(n, np.int64), self.postings, self.starts, self.ends, self.of
        best = None
        for at, (s, d, gained) in enumerate(zip(order.tolist(), of[order].tolist(), impact[order].tolist(), strict=True), 1):
            np.add.at(total, postings[d][starts[s] : ends[s]], gained)
            if at in looks:
                gain = np.zeros(self.dims, np.int64)  # the largest positive impact of a dimension still to come
                np.maximum.at(gain, of[order[at:]], impact[order[at:]])
                some = np.argpartition(total, n - 4 * k)[n - 4 * k :]
                found = np.partition(exact(some), len(some) - k)[len(some) - k]
                best = found if best is None else max(best, found)
                members = np.flatnonzero(total + gain.sum() >= best)
                if at == len(order) or len(members) * self.dims <= (done[-1] - done[at - 1]) * RESCORED:
                    return self._best(members, exact(members), k)
        raise AssertionError("the last segment is a look")

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        # rows are in order of id, so a stable sort keeps the smaller id first
        order = np.argsort(-scores, kind="stable")[:k]
        return rows[order], scores[order]


def indexed_rows(df: DataFrame, id: str, vector: str, dims: int, k: int) -> DataFrame:
    """vec_id, x (packed) and ``place``, the row's place among those of its vector; each row once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, x = whole_numbers(batch.column(1), dims, SCALE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(held)), packed(x)], names=["vec_id", "x"])

    rows = df.select(F.col(id).cast("long").alias("vec_id"), vector).mapInArrow(read, "vec_id long, x binary").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last())))


def top_k(df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best other rows for each row whose id is divisible by ``every``."""
    spark, dims = df.sparkSession, dimensions(df, vector)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    valid = df.where(F.col(vector).isNotNull())
    candidates = materialize(indexed_rows(valid, id, vector, dims, k).where(F.col("place") <= k + 1), "indexed")
    queries = materialize(indexed_rows(valid.where(F.col(id) % every == 0), id, vector, dims, k).drop("place"), "queries")
    n, asked = candidates.count(), queries.count()
    blocks = max(1, -(-n // block))
    # few blocks: more groups, so that there are tasks for all cores
    groups = max(1, -(-asked // group), min(-(-asked // 64), -(-2 * spark.sparkContext.defaultParallelism // blocks)))
    dealt = lambda rows, parts: F.pmod(F.xxhash64("vec_id", "x"), F.lit(parts)).cast("int")
    every_group, every_block = (F.explode(F.sequence(F.lit(0), F.lit(m - 1))) for m in (groups, blocks))
    left = candidates.select(dealt(candidates, blocks).alias("block"), every_group.alias("part"), F.lit(0).alias("kind"), "vec_id", "x")
    right = queries.select(every_block.alias("block"), dealt(queries, groups).alias("part"), F.lit(1).alias("kind"), "vec_id", "x")
    # a task has whole (block, part) cells: first the block's rows, then its queries, equal vectors side by side
    cells = left.unionByName(right).repartition(blocks * groups, "block", "part").sortWithinPartitions("block", "part", "kind", "x", "vec_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, xs, index, last, got = None, [], [], None, None, None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c), np.int64) for c in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if a == b:
                    continue
                part, (own, kind) = batch.slice(a, b - a), (tuple(keys[a, :2]), keys[a, 2])
                if own != cell:
                    cell, ids, xs, index, last = own, [], [], None, None
                these, x = np.asarray(part.column(3).fill_null(_NO_ID), np.int64), unpacked(part.column(4), dims)
                if kind == 0:
                    ids.append(these)
                    xs.append(x)
                    continue
                if not ids:
                    continue
                if index is None:
                    index, ids, xs = ImpactIndex(np.concatenate(ids), np.concatenate(xs)), [True], []
                out = []
                for one, q in zip(these.tolist(), x, strict=True):
                    if last is None or not np.array_equal(last, q):
                        last, got = q, index.search(q, k + 1)
                    key = int.from_bytes(hashlib.blake2b(q.tobytes(), digest_size=8).digest(), signed=True)
                    out += [(one, key, None if index.ids[r] == _NO_ID else int(index.ids[r]), max(min(int(s), 2**63 - 1), -(2**63))) for r, s in zip(*got, strict=True) if index.ids[r] != one or not np.array_equal(index.x[r], q)]
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "which", "vec_id", "score"])

    found = cells.mapInArrow(search, "query_id long, which long, vec_id long, score long")
    own = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: The registered query for an independent engine: every query against every row.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
