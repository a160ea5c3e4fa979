"""Token ids as files of fixed-width bit-packed ids.

Documents go to files in ascending doc_id order. A file's layout, little-endian::

    8 bytes  b"CWBITS01"
    6 x u64  part, documents, ids, bits an id, ids a block, blocks
    i64      doc_id of each document
    u8       1 where that doc_id is not null
    u64      ids up to the end of each document
    u64      byte offset of each block in the payload, and of its end
    payload  blocks; id k of a block lies in bits k * bits up to (k + 1) * bits, lowest bit first

An id takes the fewest bits that hold the vocabulary, and each block starts at a byte, so any range of ids is read
from its own blocks alone. Spark's own writer stores the files, as the ``content`` of one Parquet row a file (``part``,
``n_docs``, ``n_ids`` beside it): any storage that Spark opens serves, and a lost or repeated attempt leaves one whole
file. Rows with the same id are spread over files by a hash of their text, so a hot id (or null) fills many tasks.

Null text counts as empty (the end id alone); documents without an id come first; documents of one id lie in the order
of their texts' hash, then text; repeated rows are written as often as they occur; a text of any length is one document,
in the memory of its own file; an empty table writes no file and reads as an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm.packing import document_ids
from candlewick.sources.scratch import new_path
from candlewick.llm.tokens import END_ID, encoder, vocabulary_path

MAGIC = b"CWBITS01"
BLOCK = 4096
FILE_TEXT_BYTES = 16 << 20
LOT = 1000
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}


def bits_for(vocabulary_size: int) -> int:
    return max(1, math.ceil(math.log2(max(2, vocabulary_size))))


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """One block's ids, ``bits`` each, lowest bit first."""
    if bits in _WHOLE:
        return ids.astype(_WHOLE[bits]).tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_ids(block: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in _WHOLE:
        return np.frombuffer(block, _WHOLE[bits], n).astype(np.uint32)
    got = np.unpackbits(np.frombuffer(block, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (got.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def encode_file(part: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    blocks = [pack_ids(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = MAGIC + struct.pack("<6Q", part, len(doc_ids), len(ids), bits, block, len(blocks))
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is not None for d in doc_ids], "u1").tobytes()
    return b"".join([head, keys, np.cumsum(lengths).astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """A file's bytes, read by ranges of ids or by document."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        self.part, n, self.n_ids, self.bits, self.block, blocks = struct.unpack_from("<6Q", content, 8)
        at = 56
        keys = np.frombuffer(content, "<i8", n, at)
        valid = np.frombuffer(content, "u1", n, at + 8 * n)
        self.doc_ids = [int(k) if v else None for k, v in zip(keys, valid, strict=True)]
        self.ends = np.frombuffer(content, "<u8", n, at + 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(content, "<u8", blocks + 1, at + 17 * n).astype(np.int64)
        self.payload = memoryview(content)[at + 17 * n + 8 * (blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` up to ``stop``, from the blocks that hold them."""
        first, last = start // self.block, -(-stop // self.block)
        got = [unpack_ids(self.payload[self.offsets[k] : self.offsets[k + 1]], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(first, last)]
        return np.concatenate(got)[start - first * self.block : stop - first * self.block] if got else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_token_files(docs: DataFrame, path: str, vocabulary: str, file_text_bytes: int = FILE_TEXT_BYTES) -> None:
    """Tokenize ``docs`` (doc_id, text) and write files to the new folder ``path``. Parts ascend with doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // file_text_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, doc_ids, lengths, ids = TaskContext.get().partitionId(), [], [], []
        bits = bits_for(encoder(vocabulary).tokenizer.get_vocab_size())
        kind = np.uint16 if bits <= 16 else np.uint32
        for batch in batches:
            for lot in range(0, batch.num_rows, 1000):
                rows = batch.slice(lot, 1000)
                found, ends = encoder(vocabulary).encode_texts(rows.column(1))
                ids.append(np.insert(found, ends[1:], END_ID).astype(kind))
                doc_ids += rows.column(0).to_pylist()
                lengths += (np.diff(ends) + 1).tolist()
        if doc_ids:
            joined = np.concatenate(ids)
            ids.clear()  # the file's parts are not held twice
            whole = encode_file(part, doc_ids, lengths, joined, bits)
            columns = [pa.array([part]), pa.array([len(doc_ids)]), pa.array([sum(lengths)]), pa.array([whole], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "n_docs", "n_ids", "content"])

    ordered = docs.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    ordered.mapInArrow(write, "part long, n_docs long, n_ids long, content binary").write.option("compression", "none").parquet(path)


def _starts(files: DataFrame) -> DataFrame:
    """part, base: ids of all parts before it. Parts are summed in lots of ``LOT``, then lots, so no task orders all."""
    rows = files.select("part", "n_ids", F.expr(f"part div {LOT}").alias("lot"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    lots = rows.groupBy("lot").agg(F.sum("n_ids").alias("n")).withColumn("lot_base", F.coalesce(F.sum("n").over(before(Window.orderBy("lot"))), F.lit(0)))
    own = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("lot").orderBy("part"))), F.lit(0))
    return rows.withColumn("own", own).join(lots, "lot").select("part", (F.col("lot_base") + F.col("own")).alias("base"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files in ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema("part long, n_docs long, n_ids long, content binary").parquet(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content"), strict=True):
                file = TokenFile(content.as_buffer().to_pybytes())
                n = np.diff(file.ends, prepend=0)
                crc = [zlib.crc32(file.document(k).astype("<u4").tobytes()) for k in range(len(n))]
                columns = [pa.array(np.full(len(n), part)), pa.array(file.doc_ids, pa.int64()), pa.array(file.ends - n), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = files.select("part", "content").mapInArrow(read, "part long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(_starts(files), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")  # contents do not move


def token_file_digest(docs: DataFrame, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and read them back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_token_files(docs, path, vocabulary or vocabulary_path())
    return read_token_files(spark, path)
