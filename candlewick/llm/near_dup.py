"""MinHash near-duplicates: banded candidates, odd sketches to sift them, exact Jaccard on full sets to confirm.

A document's set holds its distinct five-word shingles (with fewer words, the whole sequence). Two documents are linked
where 100 * |A & B| >= 75 * |A | B|; components of links are groups, and a group keeps its smallest doc_id.

1. *Signatures*, where the texts lie: size, a 128-bit key of the set, band hashes of the first ``ROWS * BANDS`` of
   ``SAMPLES`` MinHash values, and an odd sketch: each value flips one of ``SKETCH_BITS`` bits, so d differing bits
   estimate the similarity as 1 + SKETCH_BITS / (4 * SAMPLES) * ln(1 - 2 d / SKETCH_BITS), most precisely where it is
   high.
2. *Classes*: equal sets are one class, so thousands of exact copies cost one node, named by the smallest doc_id.
3. *Buckets*: classes with an equal band. At similarity 0.75 a pair shares none of 32 bands of 4 with probability 5e-6.
4. *Stars*: in each bucket all members are held against one hub, the member with the most bucket mates; sketches sift,
   full sets confirm, components follow.
5. *The rest*: in buckets that still hold several components every pair from different components is sifted by
   sketches, in blocks of ``BLOCK`` members, in the first bucket that the pair shares; members of the largest component
   are never paired with each other. Pairs that pass are confirmed on full sets. So each bucket ends with all its pairs
   either joined or refuted.

A true pair fails the sift (over ``MAX_DIFFERENT`` bits) with probability under 1e-5; a pair whose smaller set has under
0.75 of the larger one's shingles is refuted by that alone. A band's rows are dealt to salts before they meet what is
known of the band. Tables that no later step reads are removed. Texts are compared in streams: pairs lie sorted by hub, a hub's members dealt to salts, and a task holds one hub's set at a time.

A null or wordless text has an empty set and no links. Documents without a doc_id are linked with nothing. Rows that
repeat a doc_id are one document, with the links of each of its texts. Ties among hubs go to the larger id. A text of any
length is read whole, in memory for its own row. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.components import components
from candlewick.llm.storage import materialize, remove
from candlewick.llm.words import mix, shingle_sets

ROWS, BANDS = 4, 32
SAMPLE_BITS = 10
SAMPLES = 1 << SAMPLE_BITS
SKETCH_BITS = 4096
#: Of differing sketch bits; beyond lie estimates under 0.68, 4.5 standard errors from 0.75.
MAX_DIFFERENT = 562
NEED, OF = 75, 100
BLOCK = 256
SALT_MEMBERS = 200

SALT_BAND = 20_000
_THROWS = 8 * SAMPLES
_ROUNDS = np.random.Generator(np.random.PCG64(1997)).integers(0, 2**64, (2 * SAMPLES, 1), dtype=np.uint64)
_SIGNATURE = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"


def minhash(shingles: np.ndarray) -> np.ndarray:
    """``SAMPLES`` MinHash samples of a non-empty set, by throws in rounds (fast similarity sketching): in each round every
    shingle is thrown at one sample, which keeps its first round's least value; round ``SAMPLES`` + k throws all shingles
    at sample k. Two sets agree in a sample with their similarity as probability, and the number of samples in which they
    agree spreads no wider than for independent hashes; but a set of n costs n + SAMPLES * log(SAMPLES) throws, not n * SAMPLES."""
    held = np.full(SAMPLES, 2**64 - 1, np.uint64)
    first = 0
    while first < SAMPLES and (held == 2**64 - 1).any():
        last = min(SAMPLES, first + -(-_THROWS // len(shingles)))
        for a in range(0, len(shingles), _THROWS):  # stays in a core's cache
            h = mix(shingles[None, a : a + _THROWS] ^ _ROUNDS[first:last])
            value = (h & np.uint64(2**32 - 1)) | (np.arange(first, last, dtype=np.uint64)[:, None] << np.uint64(32))
            np.minimum.at(held, (h >> np.uint64(64 - SAMPLE_BITS)).astype(np.int64).ravel(), value.ravel())
        first = last
    empty = np.flatnonzero(held == 2**64 - 1)
    for lot in np.array_split(empty, -(-len(empty) * len(shingles) // (1 << 20)) or 1):
        held[lot] = (mix(shingles ^ _ROUNDS[SAMPLES + lot]) >> np.uint64(1)).min(1) | np.uint64(1 << 63)
    return (mix(held) >> np.uint64(32)).astype(np.uint32)


def band_hashes(least: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least[: ROWS * BANDS].reshape(BANDS, ROWS).T.astype(np.uint64):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + row)
    return out.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set of MinHash samples, as 64-bit words."""
    bit = mix(least.astype(np.uint64) + (np.arange(len(least), dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text); key, bands and sketch are null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lot in range(0, whole.num_rows, 2000):
                batch = whole.slice(lot, 2000)
                n, keys, bands, sketches = [], [], [], []
                for shingles in shingle_sets(batch.column(1)):
                    n.append(len(shingles))
                    if len(shingles):
                        least = minhash(shingles)
                        second = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
                        keys.append(np.array([shingles.sum(dtype=np.uint64), second.sum(dtype=np.uint64)]).tobytes())
                        bands.append(band_hashes(least))
                        sketches.append(odd_sketch(least))
                    else:
                        keys.append(None)
                        bands.append(None)
                        sketches.append(None)
                made = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, _SIGNATURE)


def _different(a: str, b: str) -> Column:
    """Differing bits of two sketches."""
    words = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)]
    total = words[0]
    for w in words[1:]:
        total = total + w
    return total


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text) sorted so that a hub's own row (b null) comes before its members': the pairs that are linked."""
    hub, own = None, None
    for whole in batches:
        for lot in range(0, whole.num_rows, 500):
            batch = whole.slice(lot, 500)
            found: list[tuple[int, int]] = []
            for a, b, shingles in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                if b is None:
                    hub, own = a, [shingles, *(own if hub == a else [])]
                    continue
                for other in own if hub == a else ():
                    both = len(np.intersect1d(other, shingles, assume_unique=True))
                    if OF * both >= NEED * (len(other) + len(shingles) - both) and both:
                        found.append((a, b))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked. ``texts``: node, text."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_MEMBERS).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    members = members.join(texts, members["b"] == texts["node"]).select("a", "salt", "b", "text")
    hubs = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hubs = hubs.join(texts, hubs["a"] == texts["node"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    streams = members.unionByName(hubs).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return streams.select("a", "b", "text").mapInArrow(_linked, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of sorted batches; one run is held at a time."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        values = [np.asarray(held[k]) for k in keys]
        cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], 0)) + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1] if len(cuts) else 0).combine_chunks()
    if held is not None:
        yield held


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components whose sizes and sketches are close, of rows sorted by block pair; only where no band
    that both have comes before the group's, so that a pair is met once."""
    for group in _groups(batches, ["band", "x", "y"]):
        node, comp, block, n = (np.asarray(group[c]) for c in ("node", "comp", "block", "n"))
        sketch = np.asarray(group["sketch"].combine_chunks().flatten()).view(np.uint64).reshape(len(node), -1)
        bands = np.asarray(group["bands"].combine_chunks().flatten()).reshape(len(node), -1)
        at = int(np.flatnonzero(bands[0] == group["band"][0].as_py())[0])
        one = block[0] == block[-1] and len(set(block.tolist())) == 1
        left = np.arange(len(node)) if one else np.flatnonzero(block == block.min())
        right = left if one else np.flatnonzero(block != block.min())
        a, b = [], []
        for i in left:
            other = right[(comp[right] != comp[i]) & ((node[right] > node[i]) | (not one))]
            other = other[OF * np.minimum(n[other], n[i]) >= NEED * np.maximum(n[other], n[i])]
            other = other[~(bands[other, :at] == bands[i, :at]).any(1)]
            near = other[np.bitwise_count(sketch[other] ^ sketch[i]).sum(1, dtype=np.int64) <= MAX_DIFFERENT]
            a.append(np.minimum(node[i], node[near]))
            b.append(np.maximum(node[i], node[near]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _labelled(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _with_band(members: DataFrame, of_bands: DataFrame) -> DataFrame:
    """Join ``members`` with one row a band (``band``, ``mates``, ...); a band's members are dealt to salts of ``SALT_BAND``."""
    salts = F.ceil(F.col("mates") / SALT_BAND).cast("int")
    dealt = members.withColumn("_salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    spread = of_bands.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("mates")
    return dealt.join(spread, ["band", "_salt"]).drop("_salt")


def _unresolved(members: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component."""
    mixed = members.groupBy("band", "mates").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low <> _high")
    return _with_band(members, mixed).select(members.columns)


def _star_pairs(members: DataFrame, classes: DataFrame, rank: Column) -> DataFrame:
    """Pairs of each bucket's hub with its members of other components, sizes and sketches close."""
    hubs = members.groupBy("band", "mates").agg(F.max_by(F.struct("node", "comp"), F.struct(rank, "node")).alias("hub"))
    pairs = _with_band(members, hubs).where("comp <> hub.comp").select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    sketches = classes.select("node", "n", "sketch")
    pairs = pairs.join(sketches.withColumnsRenamed({"node": "a", "sketch": "sa", "n": "na"}), "a").join(sketches.withColumnsRenamed({"node": "b", "sketch": "sb", "n": "nb"}), "b")
    alike = OF * F.least("na", "nb") >= NEED * F.greatest("na", "nb")
    return pairs.where(alike & (_different("sa", "sb") <= MAX_DIFFERENT)).select("a", "b").distinct()


def _block_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of different components in each bucket, sizes and sketches close; see the module's text."""
    parts = members.groupBy("band", "mates", "comp").agg(F.count("*").alias("n"))
    largest = parts.groupBy("band", "mates").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.max("n").alias("n_major"), F.sum("n").alias("n_all"))
    sizes = largest.select("band", "mates", "major", F.ceil(F.col("n_major") / BLOCK).cast("int").alias("major_blocks"), F.ceil((F.col("n_all") - F.col("n_major")) / BLOCK).cast("int").alias("blocks"))
    rows = _with_band(members, sizes).join(classes.select("node", "n", "sketch", "bands"), "node")
    own = F.when(F.col("comp") == F.col("major"), F.col("blocks") + F.pmod(F.hash("node"), F.col("major_blocks"))).otherwise(F.pmod(F.hash("node"), F.col("blocks"))).cast("int")
    rows = rows.withColumn("block", own).withColumn("most", F.when(F.col("comp") == F.col("major"), F.col("blocks")).otherwise(F.col("blocks") + F.col("major_blocks")))
    rows = rows.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("most") - 1)))
    dealt = rows.select("band", F.least("block", "mate").alias("x"), F.greatest("block", "mate").alias("y"), "block", "node", "comp", "n", "sketch", "bands")
    return dealt.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(_sift, "a long, b long").distinct()


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text); see the module's text."""
    signed = materialize(signatures(docs), "signatures")
    classes = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.where("node IS NOT NULL"), "classes")
    rows = classes.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("mates")).where("mates > 1")
    members = materialize(rows.join(shared, "band").distinct(), "members")
    central = members.groupBy("node").agg(F.sum("mates").alias("central"))
    wanted = central.select(F.col("node").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(wanted, "doc_id", "left_semi")
    texts = materialize(texts.withColumnRenamed("doc_id", "node"), "texts")

    first = materialize(_star_pairs(members.join(central, "node").withColumn("comp", F.col("node")), classes, F.col("central")), "pairs")
    links = materialize(confirmed(first, texts), "links")
    comps = components(links)
    rest = materialize(_unresolved(_labelled(members.where("mates > 2"), comps)), "rest")
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    others = materialize(_untested(_block_pairs(rest, classes), tested), "pairs")
    more = materialize(confirmed(others, texts), "links")
    used = [members, texts, first, links, rest, others, more]
    if more.head(1):  # the components so far hold all that the links before have joined
        used.append(comps)
        comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))
    for done in used:
        remove(done)

    by_class = classes.select("set_key", "node").join(comps, "node", "left").select("set_key", "node", F.coalesce("comp", "node").alias("component"))
    found = signed.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"))


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return ordered.join(tested, ["a", "b"], "left_anti")


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, but those of documents whose group keeps another one."""
    gone = near_duplicate_groups(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
