"""Sharding by a k-d tree: weighted medians along the widest metadata dimension, until leaves reach their bytes.

A row's weight is its size (UTF-8 bytes of the text plus 8). Dimensions are the source, the language and the size. Each is
mapped to the share of all bytes that lies before the row's value (sources and languages in the order of a hash, since
they have none of their own), so a width of 0.3 means the same in each: 30 % of all bytes lie from a node's first value to
its last. The shares come from one job over ``BINS`` bins a dimension; a source or language lies in the bin of its hash.

A node of k leaves splits at the weight share of its left ``k // 2`` leaves, along its widest dimension (of equal ones
the first). Where a long text lies on the median, so that it misses by over ``MISS`` of a leaf, the next widest dimension is
tried as well, and the one that misses least is taken. Within a bin rows lie in the order of a hash of the text, then of the id: a source with a third of all rows
splits as finely as any. Equal texts (the groups) count as of the first of their sources and languages, so they lie side by
side in every dimension: in one shard unless a median falls between them, which it must where a group outweighs a shard.

A level takes two jobs over the narrow table: the nodes' weights and ends, then histograms of ``CUTS`` bins between those
ends, for all nodes at once; a bin of several rows that weighs over ``TOLERANCE`` of a leaf takes another. Only bins reach the driver.
DataFrame operations alone.

Null text has size 8 and the checksum of no bytes; null source, lang or doc_id are values of their own. Rows that are
equal in id and text tie on every dimension and stay together. A text of any length is one row, in one shard. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.ranks import rank_within
from candlewick.llm.storage import materialize, remove

SHARDS = 24
BINS = 1024
CUTS = 8192
TOLERANCE = 0.0005
#: Of a leaf: what a median may miss before the next dimension is tried.
MISS = 0.002
_TEXT_BITS, _ID_BITS = 16, 14
_TIES = 1 << (_TEXT_BITS + _ID_BITS)
_PLACES = _TIES << 30
DIMENSIONS = ("source", "lang", "size")


@dataclass
class _Node:
    leaves: int
    first: int
    dimension: str = ""
    at: int = 0
    left: _Node | None = None
    right: _Node | None = None


def _label(node: _Node) -> Column:
    """The first shard of the leaf, or unsplit node, that a row falls in."""
    if node.left is None:
        return F.lit(node.first)
    return F.when(F.col(f"k_{node.dimension}") < node.at, _label(node.left)).otherwise(_label(node.right))


def described(docs: DataFrame) -> tuple[DataFrame, dict[str, list[int]]]:
    """doc_id, size, text_crc32 and each dimension's b_ (bin) and k_ (place) of every row; and the places where bins begin."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    bin_of = lambda c: F.pmod(F.xxhash64(c), F.lit(BINS)).cast("int")
    size = (F.octet_length(body) + 8).cast("long")
    tie = F.pmod(F.xxhash64(body), F.lit(1 << _TEXT_BITS)) * (1 << _ID_BITS) + F.pmod(F.xxhash64(F.col("doc_id").cast("long"), body), F.lit(1 << _ID_BITS))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("hash"), tie.alias("tie"), word("source").alias("source"), word("lang").alias("lang")), "hashed")
    # equal texts lie where the first of their sources and languages does
    text, both = ["size", "text_crc32", "hash"], ("source", "lang")
    ends = rows.groupBy(*text).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in both for f in (F.min, F.max)])
    mixed = ends.where(" OR ".join(f"min_{c} <> max_{c}" for c in both)).drop(*[f"max_{c}" for c in both])
    rows_in = rows.join(mixed, text, "left").select("doc_id", "size", "text_crc32", "tie", *[bin_of(F.coalesce(f"min_{c}", c)).alias(f"b_{c}") for c in both])
    bare = materialize(rows_in.withColumn("b_size", F.least(F.lit(BINS - 1), F.floor(F.log2(F.col("size").cast("double")) * (BINS // 40))).cast("int")), "described")
    remove(rows)
    of_bins = bare.select("size", F.posexplode(F.array(*[f"b_{d}" for d in DIMENSIONS])).alias("dim", "bin")).groupBy("dim", "bin").agg(F.sum("size").alias("size"))
    weight = {(DIMENSIONS[r["dim"]], r["bin"]): r["size"] for r in of_bins.collect()}  # at most BINS rows a dimension
    places, keys = {}, {}
    for d in DIMENSIONS:
        ends = [0, *accumulate(weight.get((d, k), 0) for k in range(BINS))]
        places[d] = [x * (_PLACES // _TIES) // max(1, ends[-1]) * _TIES for x in ends]
        begin = "array({})".format(", ".join(f"{x}L" for x in places[d]))
        keys[f"k_{d}"] = F.expr(f"{begin}[b_{d}] + ({begin}[b_{d} + 1] - {begin}[b_{d}]) div {_TIES} * tie")
    rows = materialize(bare.withColumns(keys).drop("tie"), "placed")  # so that no plan spells the places out again
    remove(bare)
    return rows, places


def _split(rows: DataFrame, places: dict[str, list[int]], root: _Node, open_nodes: list[_Node]) -> None:
    """Set dimension and place of the split of each open node."""
    ends = [f(f"{k}_{d}").alias(f"{f.__name__}_{k}_{d}") for d in DIMENSIONS for k in "bk" for f in (F.min, F.max)]
    found = {r["node"]: r for r in rows.groupBy(_label(root).alias("node")).agg(F.sum("size").alias("size"), *ends).collect()}
    wanted: dict[int, float] = {}
    window: dict[int, tuple[int, int, float]] = {}  # node: first place, places, weight before them
    order: dict[int, list[str]] = {}  # node: dimensions that are not tried, the widest first

    def begin(node: _Node) -> None:
        node.dimension = order[node.first].pop(0)
        low, high = (found[node.first][f"{f}_k_{node.dimension}"] for f in ("min", "max"))
        window[node.first] = (low, high - low + 1, 0.0)

    for node in open_nodes:
        r = found.get(node.first)
        if r is None:
            node.dimension = DIMENSIONS[0]
            continue
        order[node.first] = sorted(DIMENSIONS, key=lambda d: places[d][r[f"min_b_{d}"]] - places[d][r[f"max_b_{d}"]])
        wanted[node.first] = r["size"] * (node.leaves // 2) / node.leaves
        begin(node)
    by_first, missed = {node.first: node for node in open_nodes}, {}
    while window:
        bins = None
        for first, (low, n, _) in window.items():
            offset = F.col(f"k_{by_first[first].dimension}") - F.lit(low)
            bin_of = F.when((F.col("node") == first) & (offset >= 0) & (offset < n), F.call_function("div", offset, F.lit(-(-n // CUTS))))
            bins = bin_of if bins is None else F.coalesce(bins, bin_of)
        counted = rows.withColumn("node", _label(root)).withColumn("bin", bins).where("bin IS NOT NULL").groupBy("node", "bin").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        weights: dict[int, list[tuple[int, int, int]]] = {}
        for r in counted.collect():  # at most CUTS rows for each node of the level
            weights.setdefault(r["node"], []).append((r["bin"], r["size"], r["n"]))
        for first, (low, n, before) in list(window.items()):
            width, node, target = -(-n // CUTS), by_first[first], wanted[first]
            for k, weight, held in sorted(weights[first]):
                if before + weight >= target:
                    break
                before += weight
            if weight <= TOLERANCE * target / (node.leaves // 2) or held == 1 or width == 1:
                after = before + weight - target < target - before
                node.at = low + k * width + (width if after else 0)
                miss = (abs(before + weight * after - target), node.dimension, node.at)
                del window[first]
                if first not in missed or miss[0] < missed[first][0]:
                    missed[first] = miss
                if missed[first][0] > MISS * found[first]["size"] / node.leaves and order[first]:
                    begin(node)
                else:
                    _, node.dimension, node.at = missed[first]
            else:
                window[first] = (low + k * width, width, before)


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null) of every row of ``docs``."""
    rows, places = described(docs)
    root = _Node(shards, 0)
    level = [root]
    while level := [n for n in level if n.leaves > 1]:
        _split(rows, places, root, level)
        for n in level:
            n.left, n.right = _Node(n.leaves // 2, n.first), _Node(n.leaves - n.leaves // 2, n.first + n.leaves // 2)
        level = [x for n in level for x in (n.left, n.right)]
    placed = rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), _label(root).cast("int").alias("shard"))
    ranked = rank_within(placed, "shard", ["doc_id", "text_crc32"], F.struct("doc_id", "text_crc32"), -(-rows.count() // shards), "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
