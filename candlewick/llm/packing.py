"""Best-fit packing of tokenized documents into fixed-length sequences, in bulk-synchronous sweeps.

1. Texts are tokenized where they lie; only one narrow row a piece goes on: id, place, length, checksum.
2. Pieces and gaps are kept sorted by size. Sizes are whole numbers up to the capacity, so the sorted order is
   held as runs of equal size: a table of at most ``capacity`` rows at any input size, plus each piece's rank
   within its run, which Spark counts without gathering a run in one task.
3. Supersteps go down the sizes. All pieces of a size seek the smallest gap that holds them (its successor);
   of more pieces than such gaps the lower ranks win, the rest go on to the next gap size, and where no gap is
   left they open new sequences. The gaps that were met become shorter runs before the next superstep.
4. The matched runs (a few for each size) go to the tasks, which look up each piece's run by size and rank.

Only longer documents than the capacity are cut, a text of any length into as many pieces as it takes. Null text counts
as empty: its one piece is the end id. Pieces of equal size go in the order of a hash, then of their ids. Repeated rows
are packed as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.ranks import rank_within
from candlewick.llm.storage import materialize
from candlewick.llm.tokens import END_ID, encoder, vocabulary_path

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def document_ids(texts: pa.Array, vocabulary: str) -> Iterator[np.ndarray]:
    """Each text's ids, the end id last."""
    ids, ends = encoder(vocabulary).encode_texts(texts)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield np.append(ids[a:b], END_ID).astype("<u4")


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each run of up to ``capacity`` ids of a document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), document_ids(batch.column(1), vocabulary), strict=True):
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def sweep(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Match runs of pieces with runs of gaps, from the longest pieces down.

    ``counts``: pieces by length. Returns rows (length, first rank, first sequence, offset): from that rank on,
    pieces of that length go to consecutive sequences from that one, at that offset.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # free ids -> runs of (first sequence, how many)
    sizes: list[int] = []  # the keys of gaps, in order
    opened, matched = 0, []

    def add(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in gaps:
                bisect.insort(sizes, free)
            gaps.setdefault(free, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                n = -(-left // (capacity // length))
                add(capacity, opened, n)
                opened += n
                continue
            free = sizes[at]
            first, n = gaps[free].pop()
            if not gaps[free]:
                del gaps[free], sizes[at]
            met = min(n, left)
            matched.append((length, rank, first, capacity - free))
            add(free, first + met, n - met)
            add(free - length, first, met)
            rank, left = rank + met, left - met
    return np.array(matched, np.int64).reshape(-1, 4)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with ``sequence_id`` and ``offset``; see the module's text."""
    pieces = materialize(tokenized_pieces(docs, vocabulary or vocabulary_path(), capacity), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = sweep(counts, capacity)
    lengths, ranks = runs[:, 0], runs[:, 1]
    keys = np.sort(lengths << 40 | ranks)
    order = np.argsort(lengths << 40 | ranks)
    ranked = rank_within(pieces, "length", ["doc_id", "piece", "ids_crc32"], F.struct("doc_id", "piece"), sum(counts.values()), "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.asarray(batch.column("rank"))
            run = order[np.searchsorted(keys, np.asarray(batch.column("length")) << 40 | rank, "right") - 1]
            made = [runs[run, 2] + rank - runs[run, 1], runs[run, 3]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, made)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
