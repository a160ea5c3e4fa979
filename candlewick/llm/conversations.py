"""Repair of conversation structure by the cheapest edits, over an automaton of shared suffixes.

A conversation is a signature: a symbol a row, for its role's initial and its first fault. Conversations are cut from their
end into chunks of at most ``CHUNK`` symbols. Chunks are range-sorted by their signatures read from the end, so equal
suffixes lie side by side: walking along them, a task meets each node of the automaton (a suffix that any number of
conversations share) once, and computes there, for each state of the grammar, the cheapest cost to go and its best audit
from those of the next shorter suffix. A signature that a third of the conversations share is spread over tasks by
conversation; a node that lies on the border of two tasks is computed in both.

The last chunk of a conversation starts from the ends that the grammar allows. A chunk before it is solved for each state
that it may end in; which of these a long conversation takes is folded over a few numbers a chunk. An insertion belongs to
the row after it, so of the edits of a chunk from one state none begins another, and their order is that of any texts that
they are part of.

What grows with a conversation is never gathered: repeats are found by aggregation before rows meet, chunks have a fixed
size. Rows pass a task in order, sorted by shuffle, to be read as signatures and to be hashed. SHA-256 has no parts that could be joined, so one
conversation's text passes one task, as a stream.

Nulls of conv_id, turn, role and text count as one space in what is hashed or compared; null turns come first. Rows of one
turn go by role, then by the MD5 of their text. A conv_id of null is a conversation. Whole repeated rows are copies, and so
duplicates. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.llm.storage import materialize

CHUNK = 512
#: What counts as white space, and what ends a sentence.
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: Faults of a row's text.
CUT, BLANK = 1, 2
#: States of the grammar: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state that a row made user or assistant, or an insertion, leads to: the only one the grammar allows.
_MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Must be deleted.
DROP = "x"
#: For each state: the cheapest cost to go and the least of its audits, or None.
Node = list[tuple[int, str] | None]


def _inserted(node: Node) -> Node:
    """The node, with insertions before its first row."""
    for _ in range(3):
        for state, after in _MADE.items():
            if node[after] is not None:
                option = (node[after][0] + INSERT, "I" + node[after][1])
                node[state] = option if node[state] is None else min(node[state], option)
    return node


#: Nothing follows: the conversation may end where it is empty or after an assistant row.
TERMINAL = _inserted([(0, ""), None, None, (0, "")])


def ends_in(state: int) -> Node:
    """Nothing follows in this chunk, and the next one goes on from ``state``."""
    return [(0, "") if s == state else None for s in range(4)]


def before(symbol: str, after: Node) -> Node:
    """The node of a suffix that begins with ``symbol``, from that of the rest."""
    out: Node = []
    extra, role = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
    for state in range(4):
        options = [(DELETE, "D", state)]
        if symbol != DROP:
            options.append((REROLE + extra, "R", _MADE[state]))
            if state in _KEPT.get(role, {}):
                options.append((extra, "K", _KEPT[role][state]))
        costs = [(c + after[to][0], edit + after[to][1]) for c, edit, to in options if after[to] is not None]
        out.append(min(costs, default=None))
    return _inserted(out)


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) of each row after the damage."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = df.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _digest(text: str = "text") -> Column:
    return F.unhex(F.md5(text))


def signature_rows(damaged_rows: DataFrame) -> DataFrame:
    """Distinct rows without their text: how many there are (``n``), their fault, and whether the first of them is the first
    of its role and text in the conversation."""
    end = F.rtrim("text", F.lit(SPACE))
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(*STOPS), 0).otherwise(CUT)
    rows = damaged_rows.where(F.col("copies") > 0).select("conv_id", "turn", "role", _digest().alias("digest"), fault.alias("fault"), F.col("copies").cast("long").alias("n"), F.lit(0).alias("first"))
    # numbers alone are aggregated by hash; a null turn comes first
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.max(F.col("turn").isNull().cast("int")).alias("unknown"), F.min("turn").alias("turn"), F.max("fault").alias("fault"))
    turn = F.when(F.col("unknown") == 0, F.col("turn"))
    both = rows.unionByName(firsts.select("conv_id", turn.alias("turn"), "role", "digest", "fault", F.lit(0).cast("long").alias("n"), F.lit(1).alias("first")))
    return both.groupBy("conv_id", "turn", "role", "digest").agg(F.max("fault").alias("fault"), F.sum("n").alias("n"), F.max("first").alias("first"))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _chunk_schema(df: DataFrame) -> T.StructType:
    keys = [df.schema["conv_id"], df.schema["turn"]]
    return T.StructType([*[T.StructField(f.name, f.dataType) for f in keys], *T.StructType.fromDDL("role string, digest binary, k long, more boolean, signature string, " + ", ".join(f"{c} long" for c in _COUNTS)).fields])


class _Reader:
    """Reads one conversation from its end."""

    def __init__(self, conv, size: int) -> None:
        self.size = size
        self.conv, self.k, self.symbols, self.later, self.first = conv, 0, [], None, None
        self.counts, self.turns = dict.fromkeys(_COUNTS, 0), [None, None, 0]

    def add(self, turn, role, digest, fault, n, first) -> Iterator[tuple]:
        c, own = self.counts, int(first and fault != BLANK)
        c["blank"] += n if fault == BLANK else 0
        c["duplicate"] += n - own if fault != BLANK else 0
        c["truncated"] += own and fault == CUT
        initial = role[:1]
        c["illegal"] += n - 1 + (self.later is not None and initial + self.later not in ("su", "ua", "au"))
        self.later = initial
        if turn is not None and turn != self.turns[0]:
            self.turns = [turn, turn if self.turns[1] is None else self.turns[1], self.turns[2] + 1]
        symbol = initial if initial in ("s", "u", "a") else "o"
        for much, one in ((n - own, DROP), (own, symbol.upper() if fault == CUT else symbol)):
            while much:
                if len(self.symbols) == self.size:
                    yield self.chunk(True)
                some = min(much, self.size - len(self.symbols))
                self.symbols += [one] * some
                much, self.first = much - some, (turn, role, digest)

    def chunk(self, more: bool) -> tuple:
        low, high, distinct = self.turns
        self.counts["gaps"] = high - low + 1 - distinct if low is not None else 0
        out = (self.conv, *self.first, self.k, more, "".join(self.symbols), *[0 if more else self.counts[c] for c in _COUNTS])
        self.k, self.symbols = self.k + 1, []
        return out


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row for each chunk: its number from the end, whether more lie before it, its signature from the end, the key of its
    first row; the conversation's counts are in the chunk before which there is none."""
    schema = _chunk_schema(rows)
    last_first = [F.col("conv_id").asc_nulls_first(), F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("digest")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            out = []
            for conv, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if reader is None or reader.conv != conv:
                    out += [reader.chunk(False)] if reader else []
                    reader = _Reader(conv, size)
                out += reader.add(*rest)
            yield _batch(out, types)
        if reader:
            yield _batch([reader.chunk(False)], types)

    types = _arrow(schema)
    order = rows.select("conv_id", "turn", "role", "digest", "fault", "n", "first").repartition("conv_id").sortWithinPartitions(*last_first)
    return order.mapInArrow(read, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types, strict=True)], schema=types)


def solved(cut: DataFrame) -> DataFrame:
    """Chunks with ``costs`` and ``audits``: by the state they start in and, but for a conversation's last chunk, the state
    they end in. A chunk that is a conversation's first has the empty start alone."""
    schema = T.StructType([*[f for f in cut.schema.fields if f.name != "signature"], *T.StructType.fromDDL("costs array<long>, audits array<string>").fields])
    types, names = _arrow(schema), cut.columns
    at, k_at, more_at = (names.index(c) for c in ("signature", "k", "more"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, known, path = None, "", []  # nodes of the suffixes of the signature read last, shortest first
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                last, signature = row[k_at] == 0, row[at]
                if kind != last:
                    kind, known, path = last, "", [[TERMINAL] if last else [ends_in(s) for s in range(4)]]
                shared = 0
                while shared < min(len(known), len(signature)) and known[shared] == signature[shared]:
                    shared += 1
                del path[shared + 1 :]
                for symbol in signature[shared:]:
                    path.append([before(symbol, node) for node in path[-1]])
                known = signature
                cells = [node[s] for s in (range(4) if row[more_at] else [START]) for node in path[-1]]
                out.append((*[v for c, v in enumerate(row) if c != at], [c and c[0] for c in cells], [c and c[1] for c in cells]))
            yield _batch(out, types)

    # conv_id parts a signature that many conversations share
    return cut.withColumn("_last", F.col("k") == 0).repartitionByRange("_last", "signature", "conv_id").sortWithinPartitions("_last", "signature").drop("_last").mapInArrow(walk, schema)


def choices(parts: DataFrame) -> DataFrame:
    """conv_id, k and the cell of ``costs`` that each chunk of a long conversation takes: the cheapest chain, of equal ones
    the least audit. Folded from a conversation's last chunk to its first; a byte or two a chunk are kept on the way."""
    schema = T.StructType([parts.schema["conv_id"], *T.StructType.fromDDL("k long, cell int").fields])
    types = _arrow(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, taken, to_go = None, [], []
        for batch in batches:
            for own, k, more, costs, audits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k == 0:
                    conv, taken, to_go = own, [bytes(4)], costs
                    continue
                starts = range(4) if more else [START]
                best, now = [], bytearray(4)
                for s in starts:
                    options = [(costs[4 * s + e] + to_go[e], audits[4 * s + e], e) for e in range(4) if costs[4 * s + e] is not None and to_go[e] is not None]
                    cost, _, now[s] = min(options, default=(None, "", 0))
                    best.append(cost)
                taken.append(bytes(now))
                to_go = best
                if not more:
                    state, out = START, []
                    for number in range(len(taken) - 1, -1, -1):
                        end = taken[number][state]
                        out.append((conv, number, 4 * state + end if number else state))
                        state = end
                    for a in range(0, len(out), 10_000):
                        yield _batch(out[a : a + 10_000], types)

    order = parts.select("conv_id", "k", "more", "costs", "audits").repartition("conv_id").sortWithinPartitions("conv_id", "k")
    return order.mapInArrow(fold, schema)


def _told(damaged_rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Results of each conversation, from its damaged rows and the edits of its chunks, merged in order."""
    schema = T.StructType([damaged_rows.schema["conv_id"], *T.StructType.fromDDL(", ".join(f"{c} long" for c in (*_COUNTS, "cost")) + ", audit string, repaired_sha256 string").fields])
    types = _arrow(schema)
    nothing = lambda kind: F.lit(None).cast(kind)
    counts = [*_COUNTS, "cost"]
    text = damaged_rows.select("conv_id", "turn", "role", _digest().alias("digest"), F.lit(1).alias("kind"), nothing("long").alias("k"), "copies", "text", nothing("string").alias("audit"), *[nothing("long").alias(c) for c in counts])
    edits = pieces.select("conv_id", "turn", "role", "digest", F.lit(0).alias("kind"), "k", F.lit(0).alias("copies"), nothing("string").alias("text"), "audit", *counts)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "kind", F.desc("k")]
    rows = text.unionByName(edits).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "kind", "copies", "text", "audit", *counts)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for batch in batches:
            out = []
            for conv, role, kind, copies, words, audit, *numbers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if one is None or one.conv != conv:
                    out += [one.end()] if one else []
                    one = _Teller(conv)
                if kind == 0:
                    one.piece(audit, numbers)
                for _ in range(copies):
                    one.row(role, words)
            yield _batch(out, types)
        if one:
            yield _batch([one.end()], types)

    return rows.mapInArrow(tell, schema)


class _Teller:
    """Carries out the edits of one conversation, a row at a time."""

    def __init__(self, conv) -> None:
        self.conv, self.audit, self.numbers = conv, [], [0] * (len(_COUNTS) + 1)
        self.state, self.hash, self.begun, self.edits, self.at = START, hashlib.sha256(), False, "", 0

    def piece(self, audit: str, numbers: list[int]) -> None:
        self.audit.append(audit)
        self.edits, self.at = self.edits[self.at :] + audit, 0
        self.numbers = [a + b for a, b in zip(self.numbers, numbers, strict=True)]

    def _write(self, role: str | None, text: str, kept: bool = False) -> None:
        made = _KEPT[role[:1]][self.state] if kept else _MADE[self.state]
        self.hash.update(("\n" if self.begun else "").encode() + f"{role if kept else 'user' if made == USER else 'assistant'}:{text}".encode())
        self.state, self.begun = made, True

    def _insertions(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self._write(None, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insertions()
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            self._write(role, text, edit == "K")

    def end(self) -> tuple:
        self._insertions()
        return (self.conv, *self.numbers, "".join(self.audit), self.hash.hexdigest())


def repair(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damaged(df)
    parts = materialize(solved(chunks(signature_rows(rows), size)), "chunks")
    keys = ["conv_id", "turn", "role", "digest", "k", *_COUNTS]
    short, long = parts.where("k = 0 AND NOT more"), parts.where("k > 0 OR more")
    chosen, cells = choices(long).withColumnRenamed("conv_id", "_conv").withColumnRenamed("k", "_k"), long
    cells = cells.join(chosen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("k") == F.col("_k")))
    both = short.withColumn("cell", F.lit(0)).select(*keys, "cell", "costs", "audits").unionByName(cells.select(*keys, "cell", "costs", "audits"))
    pieces = both.select(*keys, F.col("audits")[F.col("cell")].alias("audit"), F.col("costs")[F.col("cell")].alias("cost"))
    return _told(rows, pieces)
