"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its lower-cased words and the first four and five letters of longer ones, each present or not,
hashed to ``BUCKETS``. The model is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j: a pair of terms, such as an insult
and a group's name, has a weight of its own, which a linear model lacks.

1. Labels: rows of ``labels`` whose crc32(doc_id as text) mod 5 is not 0; of these a sample fixed by a hash of the id,
   at most ``SAMPLE`` of each class. The sample bounds the fit; class sizes over all such rows set the class weights.
2. Spark counts terms by class over the sample. Kept are terms whose class counts depart from the sample's class shares
   by a signed root likelihood ratio of ``MIN_ROOT``: no smoothing, so a word of one class alone needs a few documents
   at any sample size (3 where a ninth is toxic, 7 where half is). Kept, too, are both terms of pairs that tell only
   together: among the ``FREQUENT`` most frequent terms, pairs whose class counts depart by ``PAIR_ROOT`` from the
   shares of the sample, of either term and of both terms' log odds added. Their presence in the sample is the training
   matrix, fitted with numpy by AdaGrad. There are at most ``BUCKETS`` terms.
3. All documents are scored where they lie, whole; a task needs only the kept terms' weights.

A text without known terms (also empty or null) gets the score of w0. A null doc_id counts as empty text in the fold
rule. Several labels of one document count as toxic if one is. Unless documents of both classes are labelled (so with an
empty ``labels``, too) all scores are 0. Terms that tell equally much go by their bucket. Texts of any length are read
whole, in runs of some megabytes of whole documents. Columns other than the text are never inputs of a score; repeated
rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.words import chunks, lower_pieces

BUCKETS = 1 << 18
SAMPLE = 12_000
MIN_ROOT = 3.0
FREQUENT = 2048
PAIR_DOCS = 10
PAIR_ROOT = 6.0
#: Documents and terms of which the fit holds pair counts at once.
LOT, STRIPE = 512, 256
FACTORS = 4
EPOCHS = 60
RATE = 0.15
L2 = 2e-5
FOLDS = 5


@dataclass
class Model:
    """``place``: a bucket's row in w and v, or -1."""

    place: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, terms: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probabilities of documents whose terms (rows of w) lie between ``ends``."""
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        n = len(ends) - 1
        total = np.full(n, self.w0) + np.bincount(doc, self.w[terms], n)
        for f in range(self.v.shape[1]):
            x = self.v[terms, f]
            total += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _buckets(word: str) -> list[int]:
    """Hashed terms of a word."""
    word = word.strip("\"'()[]{}.,;:!?")
    if not word:
        return []
    out = [zlib.crc32(b"w" + word.encode()) % BUCKETS]
    out += [zlib.crc32(b"p" + word[:k].encode()) % BUCKETS for k in (4, 5) if len(word) >= k]
    return out


def terms_of(texts: pa.Array, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text, and offsets; with ``place`` its rows instead of buckets, known ones only."""
    parts, sizes = [], []
    for _, _, data, ends in chunks(texts, 1 << 23):
        pieces, first = lower_pieces(data, ends)
        coded = pieces.dictionary_encode()
        found = [_buckets(w) for w in coded.dictionary.to_pylist()]
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((b for f in found for b in f), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(found)), n)
        if place is not None:
            flat = place[flat]
            owner, flat = owner[flat >= 0], flat[flat >= 0]
        start = np.searchsorted(owner, np.arange(len(found)))
        many = np.bincount(owner, minlength=len(found))
        word = np.asarray(coded.indices).astype(np.int64)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        word, doc = word[many[word] > 0], doc[many[word] > 0]
        k = many[word]
        cum = np.cumsum(k) - k
        terms = flat[np.repeat(start[word] - cum, k) + np.arange(int(k.sum()))]
        pairs = np.unique(np.repeat(doc, k) * BUCKETS + terms)
        parts.append(pairs % BUCKETS)
        sizes.append(np.bincount(pairs // BUCKETS, minlength=len(first) - 1))
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum(sizes)])


def training_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most ``sample`` labelled rows of each class, and all training rows by class."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label")).where(fold(F.col("doc_id")) != 0)
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = [usable.where(F.col("label") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows of 12 bytes
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id"), counts


def _term_counts(sample: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            label = np.asarray(batch.column("label"))
            terms, ends = terms_of(batch.column("text"))
            own = np.repeat(label, np.diff(ends))
            for k in (0, 1):
                seen[k] += np.bincount(terms[own == k], minlength=BUCKETS)
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["term", "n0", "n1"])

    return sample.select("label", "text").mapInArrow(count, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _matrix(sample: DataFrame, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, terms (rows of ``place``, 32 bits each) and offsets of the sample's documents, by doc_id and label."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, ends = terms_of(batch.column("text"), place)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], names=["doc_id", "label", "terms"])

    got = sample.select("doc_id", "label", "text").mapInArrow(rows, "doc_id long, label int, terms array<int>").toArrow()
    label, lists, ids = np.asarray(got["label"].combine_chunks()), got["terms"].combine_chunks(), np.asarray(got["doc_id"].combine_chunks())
    del got
    order = np.lexsort([label, ids])
    lists = lists.take(pa.array(order))
    return label[order].astype(float), np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])


def _root(n1: np.ndarray, n0: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """Signed root of the likelihood ratio of class counts against an expected share of class 1."""
    n = n1 + n0
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(n1 > 0, n1 * np.log(n1 / (n * share)), 0) + np.where(n0 > 0, n0 * np.log(n0 / (n * (1 - share))), 0)
    return np.sign(n1 - n * share) * np.sqrt(2 * np.maximum(ratio, 0))


def _joint(flat: np.ndarray, ends: np.ndarray, label: np.ndarray, columns: np.ndarray, width: int, share: float) -> np.ndarray:
    """Which of ``columns`` are in a pair that tells more than its terms do; those of the most telling pairs first."""
    k = len(columns)
    at = np.full(width, -1, np.int64)
    at[columns] = np.arange(k)
    present = np.zeros((len(label), -(-k // 8)), np.uint8)  # a bit a term
    for d in range(len(label)):
        j = at[flat[ends[d] : ends[d + 1]]]
        row = np.zeros(k, bool)
        row[j[j >= 0]] = True
        present[d] = np.packbits(row)
    own = [np.flatnonzero(label == c) for c in (0, 1)]
    lots = [(c, lot) for c in (0, 1) for lot in np.array_split(own[c], max(1, len(own[c]) // LOT))]
    x_of = lambda lot: np.unpackbits(present[lot], axis=1, count=k).astype(np.float32)
    alone = np.zeros((2, k))
    for c, lot in lots:
        alone[c] += x_of(lot).sum(0)
    logit = lambda q: np.log(q / (1 - q))
    odds = logit((alone[1] + 0.5) / (alone.sum(0) + 1))
    found = []
    for i in range(k):
        if i % STRIPE == 0:  # the counts of all pairs at once would be the largest table of the fit
            both = np.zeros((2, min(STRIPE, k - i), k), np.float32)
            for c, lot in lots:
                x = x_of(lot)
                both[c] += x[:, i : i + STRIPE].T @ x
        n0, n1 = both[:, i % STRIPE, i + 1 :].astype(float)
        least = np.minimum(alone[:, i].sum(), alone[:, i + 1 :].sum(0))
        j = np.flatnonzero((n0 + n1 >= PAIR_DOCS) & (n0 + n1 <= 0.9 * least))  # a word and its own beginning are no pair
        n0, n1, other = n0[j], n1[j], odds[i + 1 + j]
        expected = (logit(share), odds[i], other, odds[i] + other - logit(share))
        root = np.min([np.abs(_root(n1, n0, 1 / (1 + np.exp(-np.asarray(q))))) for q in expected], axis=0) if len(j) else n0
        found += [(-float(z), i, i + 1 + int(b)) for z, b in zip(root, j, strict=True) if z >= PAIR_ROOT]
    first = list(dict.fromkeys(x for _, i, j in sorted(found) for x in (i, j)))
    return np.array(first, np.int64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on the labelled rows outside fold 0."""
    place = np.full(BUCKETS, -1, np.int64)
    rows, counts = training_sample(docs, labels, sample)
    untrained = Model(place.copy(), -60.0, np.zeros(0), np.zeros((0, FACTORS)))
    if len(counts) < 2:
        return untrained
    used = {k: min(sample, n) for k, n in counts.items()}
    seen = np.zeros((2, BUCKETS))
    got = _term_counts(rows).toArrow()  # at most BUCKETS rows
    seen[:, np.asarray(got["term"])] = [np.asarray(got["n0"]), np.asarray(got["n1"])]
    share = used[1] / (used[0] + used[1])
    single = np.abs(_root(seen[1], seen[0], share))
    telling = np.flatnonzero(single >= MIN_ROOT)
    often = np.argsort(-seen.sum(0), kind="stable")[:FREQUENT]
    often = often[seen.sum(0)[often] >= PAIR_DOCS]
    held = np.union1d(telling, often)
    place[held] = np.arange(len(held))
    label, flat, ends = _matrix(rows, place)
    if len(set(label.tolist())) < 2:  # labels of documents that are not there
        return untrained
    joint = often[_joint(flat, ends, label, place[often], len(held), share)]
    buckets = np.union1d(joint, telling)
    place = np.full(BUCKETS, -1, np.int64)
    place[buckets] = np.arange(len(buckets))
    flat = place[held].astype(np.int32)[flat]
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(flat >= 0, dtype=np.int32)])[ends]
    flat = flat[flat >= 0]
    weight = np.where(label == 1, counts[1] / used[1], counts[0] / used[0])
    return _fitted(Model(place, 0.0, np.zeros(len(buckets)), np.random.Generator(np.random.PCG64(5)).normal(0, 0.01, (len(buckets), FACTORS))), flat, ends, label, weight / weight.mean())


def _fitted(m: Model, flat: np.ndarray, ends: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """AdaGrad on the weighted logistic loss."""
    n, k = len(label), len(m.w)
    m.w0 = float(np.log((weight * label).sum() / (weight * (1 - label)).sum()))
    g0, gw, gv = 1e-8, np.full(k, 1e-8), np.full(m.v.shape, 1e-8)
    batches = np.array_split(np.random.Generator(np.random.PCG64(7)).permutation(n), max(1, n // 512))
    starts = [np.concatenate([np.arange(ends[d], ends[d + 1], dtype=np.int32) for d in b]) if len(b) else b for b in batches]
    for _ in range(EPOCHS):
        for rows, at in zip(batches, starts, strict=True):
            size = np.diff(ends)[rows]
            own, terms = np.repeat(np.arange(len(rows)), size), flat[at]
            sums = np.stack([np.bincount(own, m.v[terms, f], len(rows)) for f in range(FACTORS)], 1)
            squares = np.bincount(own, (m.v[terms] ** 2).sum(1), len(rows))
            y = m.w0 + np.bincount(own, m.w[terms], len(rows)) + 0.5 * ((sums**2).sum(1) - squares)
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(y, -60, 60))) - label[rows]) / len(rows)
            e = error[own]
            d0, dw = error.sum(), np.bincount(terms, e, k) + L2 * m.w
            dv = np.stack([np.bincount(terms, e * (sums[own, f] - m.v[terms, f]), k) for f in range(FACTORS)], 1) + L2 * m.v
            g0, gw, gv = g0 + d0**2, gw + dw**2, gv + dv**2
            m.w0 -= RATE * d0 / np.sqrt(g0)
            m.w -= RATE * dw / np.sqrt(gw)
            m.v -= RATE * 0.2 * dv / np.sqrt(gv)
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS bounds it

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            terms, ends = terms_of(batch.column("text"), m.place)
            p = m.scores(terms, ends)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, fit(docs, labels, sample))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that score under 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array(m.scores(*terms_of(batch.column(at).cast(pa.string()), m.place)) < 0.5))

    return docs.mapInArrow(keep, schema)
