"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased (A-Z). A seed looks at a mask's fixed positions after a word and ignores the words between them,
so its hash survives substitutions there. What counts as an overlap, and the masks that meet all of it, follow from an
item's length (``allowed``, ``masks_for``):

* ``SPAN`` words or more: any ``SPAN`` consecutive words of the item with up to 2 substituted; two spaced masks.
* 8 to 12 words: the whole item with one word substituted; four words in a row, which one substitution always leaves.
* under 8 words: the whole item, word for word; one mask of its length.

A hit fixes a text and an item position, and so a diagonal on which all of the item is compared with the text. A result
spans all runs that count on the diagonal with the most equal words.

Hashes of items and texts are joined. A benchmark of up to ``block_words`` words is a table of bounded size that goes to
the tasks: texts are searched where they lie, and nothing is shuffled. A larger one is joined by shuffle: a bitmap of its
hashes, as large as their number asks for, drops text positions that cannot meet any, the rest join item hashes, and each
document that met items passes a task once with them, to be compared in full. Both ways give the same rows.

Null or empty texts and items, and an empty benchmark, overlap with nothing; an empty table gives an empty result. Texts
of any length are searched whole; the larger overlap wins, the first diagonal where two are equal. Repeated rows and
items give repeated hits of their own ids; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.storage import materialize
from candlewick.llm.words import chunks, mix, word_hashes

SPAN, TOLERANT = 13, 8
MASKS = ((0, 1, 2, 6, 7, 8), (0, 3, 4, 6, 7, 9))
SHORT_MASK = (0, 1, 2, 3)
BLOCK_WORDS = 500_000
#: Overlaps with shorter items are reported, but drop no document.
DROP_WORDS = 5
_BITS = 22
#: Shares of a seed that is an item of a few words.
SALTS = 32
_Q = np.uint64(0xD1342543DE82EF95)
HITS = "doc_id long, item_id long, doc_word long, item_word int, n_words int, n_same int, item_words int"
Mask = tuple[int, ...]


def allowed(n: int) -> int:
    """Substituted words that an overlap with an item of ``n`` words may hold."""
    return 2 if n >= SPAN else 1 if n >= TOLERANT else 0


def masks_for(n: int) -> tuple[Mask, ...]:
    return MASKS if n >= SPAN else (SHORT_MASK,) if n >= TOLERANT else (tuple(range(n)),) if n else ()


def seeds(words: np.ndarray, mask: Mask) -> np.ndarray:
    out = np.full(max(0, len(words) - mask[-1]), sum(1 << k for k in mask), np.uint64)
    for offset in mask:
        out = out * _Q + words[offset : offset + len(out)]
    return mix(out)


def item_seeds(words: np.ndarray) -> Iterator[tuple[Mask, np.ndarray]]:
    """Each mask of an item and its seeds from the item's first word on."""
    for mask in masks_for(len(words)):
        yield mask, seeds(words, mask)


class _Table:
    """Seeds of the items."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        by_mask: dict[Mask, list[tuple[np.ndarray, int]]] = {}
        for k, (_, words) in enumerate(items):
            for mask, seed in item_seeds(words):
                by_mask.setdefault(mask, []).append((seed, k))
        self.masks = []
        for mask, found in sorted(by_mask.items()):
            seed = np.concatenate([s for s, _ in found])
            item = np.repeat([k for _, k in found], [len(s) for s, _ in found])
            at = np.concatenate([np.arange(len(s)) for s, _ in found])
            order = np.argsort(seed, kind="stable")
            there = np.zeros(1 << _BITS, bool)
            there[seed >> np.uint64(64 - _BITS)] = True
            self.masks.append((mask, seed[order], item[order], at[order], there))

    def diagonals(self, words: np.ndarray) -> dict[int, set[int]]:
        """Text positions of an item's first word by every hit."""
        found: dict[int, set[int]] = {}
        for mask, seed, item, at, there in self.masks:
            own = seeds(words, mask)
            maybe = np.flatnonzero(there[own >> np.uint64(64 - _BITS)])
            low, high = (np.searchsorted(seed, own[maybe], side) for side in ("left", "right"))
            hit = np.flatnonzero(high > low)
            for p, a, b in zip(maybe[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                for k, q in zip(item[a:b].tolist(), at[a:b].tolist(), strict=True):
                    found.setdefault(k, set()).add(p - q)
        return found


def overlap_on(text: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(first item word, words, equal words) from the first to the last run on a diagonal that counts, or None."""
    a, b = max(0, -diagonal), min(len(item), len(text) - diagonal)
    n = min(SPAN, len(item))
    if b - a < n:
        return None
    same = np.concatenate([[0], np.cumsum(text[a + diagonal : b + diagonal] == item[a:b])])
    runs = np.flatnonzero(same[n:] - same[:-n] >= n - allowed(len(item)))
    if not len(runs):
        return None
    start, stop = int(runs[0]), int(runs[-1]) + n
    return a + start, stop - start, int(same[stop] - same[start])


def largest_overlap(text: np.ndarray, item: np.ndarray, diagonals: Iterable[int]) -> tuple[int, int, int, int, int] | None:
    """(text word, item word, words, equal words, item's words) of the diagonal with the most equal words."""
    found = [(d + f[0], *f, len(item)) for d in sorted(diagonals) if (f := overlap_on(text, item, d))]
    return max(found, key=lambda f: f[3], default=None)


def _words_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    for _, _, data, ends in chunks(texts):
        words, at = word_hashes(data, ends)
        yield from (words[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    kinds = [pa.int64()] * 3 + [pa.int32()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in HITS.split(", ")])


def _held_in_tasks(texts: DataFrame, items: DataFrame) -> DataFrame:
    rows = items.orderBy("item_id", "text").toArrow()  # at most ``block_words`` words
    known = [(i, w) for i, w in zip(rows["item_id"].to_pylist(), _words_of(rows["text"].combine_chunks()), strict=True)]
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(shared.value)
        for batch in batches:
            out = []
            for doc, words in zip(batch.column("doc_id").to_pylist(), _words_of(batch.column("text")), strict=True):
                for k, diagonals in sorted(table.diagonals(words).items()):
                    if found := largest_overlap(words, table.items[k][1], diagonals):
                        out.append((doc, table.items[k][0], *found))
            yield _hits(out)

    return texts.mapInArrow(search, HITS)


def _seed_rows(rows: DataFrame, key: str, masks: tuple[Mask, ...] | None, bitmap: np.ndarray | None) -> DataFrame:
    """(key, seed, at, exact) of all of a text's positions that ``bitmap`` lets pass, or of an item's own masks. ``exact``: of a
    mask that is a whole item, of which any hit is as good as another, so a text gives its first one alone."""
    shared, shift = rows.sparkSession.sparkContext.broadcast(bitmap), 0 if bitmap is None else 62 - int(bitmap.size).bit_length()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, words in zip(batch.column(key).to_pylist(), _words_of(batch.column("text")), strict=True):
                for mask, seed in item_seeds(words) if masks is None else ((m, seeds(words, m)) for m in masks):
                    at, exact = np.arange(len(seed)), mask not in (*MASKS, SHORT_MASK) or masks is None and len(words) < TOLERANT
                    if shared.value is not None:
                        bit = (seed >> np.uint64(shift)).astype(np.int64)
                        at = np.flatnonzero(shared.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                        at = at[np.sort(np.unique(seed[at], return_index=True)[1])] if exact else at
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(seed[at].view(np.int64)), pa.array(at), pa.array(np.full(len(at), exact))], names=[key, "seed", "at", "exact"])

    return rows.select(key, "text").mapInArrow(emit, f"{key} long, seed long, at long, exact boolean")


def _bits(n: int) -> int:
    """Of a bitmap in which ``n`` seeds set at most a sixteenth: 8 KB at least, 512 MB at most (beyond 268 million seeds more
    positions pass, and are compared)."""
    return min(32, max(16, (16 * n - 1).bit_length()))


def _bitmap(of_items: DataFrame, bits: int) -> np.ndarray:
    bit = F.shiftrightunsigned("seed", 64 - bits)
    parts = of_items.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.toLocalIterator():  # rows of 4 KB, as large as the bitmap together
        out[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def _joined(texts: DataFrame, items: DataFrame) -> DataFrame:
    texts = materialize(texts.where("text IS NOT NULL").withColumn("doc", F.monotonically_increasing_id()), "texts")
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    of_items = materialize(_seed_rows(items, "item", None, None).withColumnRenamed("at", "item_at"), "seeds")
    bitmap = _bitmap(of_items, _bits(of_items.count()))
    masks = tuple(sorted({*MASKS, SHORT_MASK, *(tuple(range(k)) for k in range(1, TOLERANT))}))
    # seeds of short items may be words of every text: they are dealt to salts
    of_texts = _seed_rows(texts, "doc", masks, bitmap).withColumn("salt", F.when(F.col("exact"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0))
    salted = of_items.withColumn("salt", F.explode(F.when(F.col("exact"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    met = of_texts.drop("exact").join(salted.drop("exact"), ["seed", "salt"]).select("doc", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    met = materialize(met, "met")
    held = met.select("doc").distinct().join(texts, "doc").select("doc", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("diagonal"), "doc_id", "text")
    asked = met.join(items, "item").select("doc", "item_id", "item", "diagonal", F.lit(None).cast("long").alias("doc_id"), "text")
    # a document's text comes once, before the items that it meets
    rows = held.unionByName(asked).repartition("doc").sortWithinPartitions("doc", F.col("item").asc_nulls_first(), "diagonal")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, doc_id, item, item_id, words, diagonals = None, None, None, None, None, []

        def done() -> Iterator[tuple]:
            if diagonals and (found := largest_overlap(own, words, diagonals)):
                yield doc_id, item_id, *found

        for whole in batches:
            for lot in range(0, whole.num_rows, 500):
                batch, out = whole.slice(lot, 500), []
                columns = [batch.column(c).to_pylist() for c in ("item", "item_id", "diagonal", "doc_id")]
                for i, i_id, diagonal, d_id, text in zip(*columns, _words_of(batch.column("text")), strict=True):
                    if i is None or i != item:
                        out += done()
                        diagonals = []
                    if i is None:
                        own, doc_id = text, d_id
                    else:
                        words, item_id = text, i_id
                        diagonals.append(diagonal)
                    item = i
                yield _hits(out)
        yield _hits(list(done()))

    return rows.mapInArrow(compare, HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and item that overlap: ids, the overlap's place in both, its words and equal words.

    ``docs``: doc_id, text. ``benchmark``: item_id, text. Documents without a row are clean.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", "[ \\t\\n\\x0B\\f\\r]+")))).first()[0] or 0
    return _held_in_tasks(texts, items) if total <= block_words else _joined(texts, items)


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop_words: int = DROP_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that overlap with no benchmark item of ``drop_words`` words or more: a shorter
    item (a name, a number) is part of many clean texts. Rows without a doc_id stay."""
    dirty = contamination(docs, benchmark).where(F.col("item_words") >= drop_words).select("doc_id").distinct()
    return docs.join(dirty, "doc_id", "left_anti").select(docs.columns)
