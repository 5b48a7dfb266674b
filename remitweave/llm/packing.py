"""Packing documents into sequences by balanced cost.

A document's whole blocks of ``length`` ids fill sequences of their own. The rest of it is a piece with the
estimated cost ``linear * n + quadratic * n**2`` of attention over n ids. Pieces are taken in descending order;
each goes to the sequence of lowest cost that still holds it, and only where none does, it is cut to fill the
room left in the cheapest ones.

Each map task packs its own rows, in pools of a bounded number of tokens. A pool opens only as many sequences as its ids fill; what would leave a
sequence part empty waits for the next pool. What is left when a task ends, at most ``ENOUGH`` ids, is written beside its
sequences, and all tasks' rests are brought together in groups of about ``POOL`` ids, which are packed alike. Only the tail of a group
fills sequences whose lengths are powers of two, which need no padding: at most log2(length) short ones in some ``POOL / length``, however many partitions the
documents have.

Defined cases: null text is empty and still has its end id; rows with the same or a null id are documents of
their own; pieces of equal length are taken in the order of their documents, and of sequences of equal cost that with most room
filled; a text of any length is packed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitweave.llm.common import materialise
from remitweave.llm.tokens import encoder

#: Ids of rests in a pool, about 16 MB.
POOL = 4_000_000
#: Ids of rests with which a task's last pool is packed in the task; fewer make a poor pool, and wait for those of other tasks.
ENOUGH = 1 << 18
#: Numbers of the tasks that pack the rests start here.
SECOND = 1 << 20


def cost(n: int, linear: float, quadratic: float) -> float:
    return linear * n + quadratic * n * n


def capacities(total: int, length: int, last: bool) -> list[int]:
    """Rooms of the sequences that ``total`` ids fill: whole ones, and with ``last`` powers of two for the rest."""
    rest = total % length if last else 0
    return [length] * (total // length) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


class Sequences:
    """Open sequences by the room they have left, each room's in a heap by cost."""

    def __init__(self, rooms: list[int]):
        self.open: list[list[tuple[float, int]]] = [[] for _ in range(max(rooms, default=0) + 1)]
        for i, r in enumerate(rooms):
            self.open[r].append((0.0, i))
        self.least = np.array([h[0][0] if h else np.inf for h in self.open])

    def cheapest(self, room: int) -> tuple[float, int, int] | None:
        """Takes out that of least cost with so much room at least: cost, sequence, room."""
        if room >= len(self.open):
            return None
        r = room + int(self.least[room:].argmin())
        if not self.open[r]:
            return None
        c, i = heapq.heappop(self.open[r])
        self.least[r] = self.open[r][0][0] if self.open[r] else np.inf
        return c, i, r

    def put(self, c: float, i: int, room: int) -> None:
        heapq.heappush(self.open[room], (c, i))
        self.least[room] = self.open[room][0][0]


def assign(pieces: list[tuple[int, int]], length: int, linear: float, quadratic: float, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """pieces: (n ids, key). Returns the sequences, lists of (key, from, to), and what is left over: with ``last``
    nothing, else fewer than ``length`` ids."""
    rooms = capacities(sum(n for n, _ in pieces), length, last)
    out: list[list[tuple[int, int, int]]] = [[] for _ in rooms]
    sequences, left = Sequences(rooms), []
    for n, key in sorted(pieces, key=lambda x: (-x[0], x[1])):
        at = 0
        while at < n:
            found = sequences.cheapest(n - at) or sequences.cheapest(1)
            if found is None:
                left.append((key, at, n))
                break
            c, i, room = found
            b = min(n, at + room)
            out[i].append((key, at, b))
            if room > b - at:
                sequences.put(c + cost(b - at, linear, quadratic), i, room - (b - at))
            at = b
    return out, left


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    length: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` ids (the
    piece's token ids, little-endian unsigned 32-bit).

    ``vocabulary``: path of a byte-level vocabulary of the tokenizers library.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    end = np.array([end_id], "<u4").tobytes()

    class Task:
        """Rows and rests of one task. A row without a sequence (-1) is a rest; others hold their ids only if they are asked for."""

        def __init__(self, first_sequence: int, id_type: pa.DataType):
            self.sequence, self.id_type = first_sequence, id_type
            self.rests: list[tuple[object, int, int, bytes]] = []  # id, start, document's ids, ids
            self.waiting = 0
            self.rows: list[tuple] = []

        def piece(self, ident: object, start: int, doc_tokens: int, ids: bytes, seq: int, offset: int) -> None:
            self.rows.append((ident, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, seq, offset, ids if with_ids or seq < 0 else None))

        def wait(self, ident: object, start: int, doc_tokens: int, ids: bytes) -> None:
            self.rests.append((ident, start, doc_tokens, ids))
            self.waiting += len(ids) // 4

        def flush(self, last: bool) -> None:
            seqs, left = assign([(len(r[3]) // 4, k) for k, r in enumerate(self.rests)], length, linear, quadratic, last)
            for s in seqs:
                offset = 0
                for key, a, b in s:
                    ident, start, doc_tokens, ids = self.rests[key]
                    self.piece(ident, start + a, doc_tokens, ids[4 * a : 4 * b], self.sequence, offset)
                    offset += b - a
                self.sequence += 1
            self.rests = [(self.rests[k][0], self.rests[k][1] + a, self.rests[k][2], self.rests[k][3][4 * a : 4 * b]) for k, a, b in left]
            self.waiting = sum(len(r[3]) // 4 for r in self.rests)

        def emit(self) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(self.rows), 4096):
                cols = list(zip(*self.rows[at : at + 4096], strict=True))
                types = [self.id_type, *[pa.int64()] * 6, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*names, "ids"])
            self.rows = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, "spaced")
        task = Task(TaskContext.get().partitionId() << 40, pa.null())
        for batch in batches:
            task.id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for ident, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    whole = n // length * length
                    for a in range(0, whole, length):
                        task.piece(ident, a, n, ids[4 * a : 4 * (a + length)], task.sequence, 0)
                        task.sequence += 1
                    if whole < n:
                        task.wait(ident, whole, n, ids[4 * whole :])
                if task.waiting >= POOL:
                    task.flush(False)
                yield from task.emit()
        if task.waiting >= ENOUGH:
            task.flush(False)
        for ident, start, doc_tokens, ids in task.rests:
            task.piece(ident, start, doc_tokens, ids, -1, 0)
        yield from task.emit()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task(TaskContext.get().partitionId() + SECOND << 40, pa.null())
        for batch in batches:
            task.id_type = batch.schema.field(0).type
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                task.wait(*row)
            if task.waiting >= 2 * POOL:
                task.flush(False)
                yield from task.emit()
        task.flush(True)
        yield from task.emit()

    first = materialise(docs.select(id_col, text_col).mapInArrow(run, schema))
    rests = first.filter("sequence_id < 0").select("id", "start", "doc_tokens", "ids")
    waiting = first.filter("sequence_id < 0").agg(F.sum("length").alias("n")).first()["n"] or 0
    second = rests.repartition(max(1, round(waiting / POOL))).mapInArrow(together, schema)
    return first.filter("sequence_id >= 0").unionByName(second).select(*names, *["ids"] * with_ids)
