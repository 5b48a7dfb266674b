"""Token ids in files of frequency-ranked, byte-aligned, variable-length codes.

What is written below a path can be read with that path alone: ``segments``, and ``ranks``, the ids by rank. A file (Parquet,
so that any store Spark can write holds it) is a sequence of segments in ascending order of the documents' ids. A segment has, for its documents, the id, the first id's place in the task's part and the number
of ids; and for all their ids together the *control* bytes (two bits for each id: its code's length less 1,
four ids to a byte, the first in the lowest bits) and the *data* bytes (the little-endian rank of the id
among all ids by falling frequency, in so many bytes). Frequent ids take one byte. The reader finds
the lengths of four codes by one table lookup per control byte.

Defined cases: null text is empty and has its end id alone; null ids come first; rows with the same id
follow one another, shorter ones first; a text of any length lies in one segment; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitweave.llm.common import map_arrow, materialise, shared_dir
from remitweave.llm.tokens import encoder

#: Ids to a segment, at least (the last document is never cut).
SEGMENT = 1_000_000
#: Lengths of the four codes of each control byte.
LENGTHS = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = lengths - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) < lengths[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    ends = np.cumsum(lengths)
    at = ends - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenised(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, ids (unsigned 16 bits where the vocabulary allows it, else 32), written once."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [x + end for x in encoder(vocabulary, "unspaced").encode(batch.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([_narrow(x) for x in ids], pa.binary())], ["id", "n", "ids"]
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return materialise(map_arrow(docs.select(id_col, text_col), run, f"id {kind}, n bigint, ids binary", memory="tokens"), compression="zstd")


def _narrow(ids: bytes) -> bytes:
    """A leading byte 2 or 4 tells the width."""
    a = np.frombuffer(ids, "<u4")
    return b"\2" + a.astype("<u2").tobytes() if not len(a) or a.max() < 1 << 16 else b"\4" + ids


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1).astype("<u4")


def ranked(tokens: DataFrame) -> np.ndarray:
    """All ids that occur, by falling frequency over the whole table (ties: smaller id). No longer than the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids = np.concatenate([_wide(x) for x in batch.column(0).slice(at, 512).to_pylist()])
                new = np.bincount(ids, minlength=len(counts))
                new[: len(counts)] += counts
                counts = new
        (seen,) = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["token", "n"])

    counts = tokens.select("ids").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    return found.sort_values(["n", "token"], ascending=[False, True]).token.to_numpy(np.uint32)


def write(docs: DataFrame, path: str, vocabulary: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the files below ``path``."""
    tokens = _tokenised(docs, vocabulary, end_id, id_col, text_col)
    by_rank = ranked(tokens)
    spark = docs.sparkSession
    table = pa.table({"rank": pa.array(range(len(by_rank)), pa.int64()), "token": pa.array(by_rank, pa.int64())})
    spark.createDataFrame(table, "rank bigint, token bigint").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    held = spark.sparkContext.broadcast(rank_of)
    id_kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, done = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        arrays: list[np.ndarray] = []
        waiting, id_type = 0, pa.null()

        def segment() -> pa.RecordBatch:
            counts = [len(a) for a in arrays]
            control, data = encode_ranks(held.value[np.concatenate(arrays)])
            row = [[part], [seg], [ids], [counts], [done], [control], [data]]
            types = [pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            names = ["part", "segment", "ids", "counts", "first", "control", "data"]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for ident, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(ident)
                arrays.append(_wide(raw))
                waiting += len(arrays[-1])
                if waiting >= SEGMENT:
                    yield segment()
                    seg, done, waiting, ids, arrays = seg + 1, done + waiting, 0, [], []
        if ids:
            yield segment()

    (
        tokens.repartitionByRange("id")
        .sortWithinPartitions("id", "n", "ids")
        .select("id", "ids")
        .mapInArrow(run, f"part bigint, segment bigint, ids array<{id_kind}>, counts array<bigint>, first bigint, control binary, data binary")
        .write.parquet(f"{path}/segments")
    )


def read(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """Per document: id, start, n_tokens, ids_crc32, and with ``with_ids`` ids.

    On the driver come together the ids by rank, no more than the vocabulary has, and one number for each write task: the parts before a
    part are summed there.
    """
    files = spark.read.parquet(f"{path}/segments")
    by_rank = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank").token.to_numpy(np.uint32)
    docs_schema_id = files.schema["ids"].dataType.elementType.simpleString()
    totals = files.select("part", F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    base, start = {}, 0
    for r in totals.orderBy("part").toLocalIterator():
        base[r["part"]] = start
        start += r["n"]
    held, bases = spark.sparkContext.broadcast(by_rank), spark.sparkContext.broadcast(base)
    names = ["id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                counts = np.array(row["counts"], np.int64)
                tokens = held.value[decode_ranks(row["control"], row["data"], int(counts.sum()))].astype("<u4")
                ends = np.cumsum(counts)
                raw = tokens.tobytes()
                each = [raw[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                first = bases.value[row["part"]] + row["first"]
                cols = [pa.array(row["ids"], id_type), pa.array(first + ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                if with_ids:
                    cols.append(pa.array(each, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return files.select("part", "ids", "counts", "first", "control", "data").mapInArrow(
        run, f"id {docs_schema_id}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    )


def round_trip(
    docs: DataFrame, vocabulary: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Write all documents and read them back from the files."""
    path = shared_dir(docs.sparkSession)
    write(docs, path, vocabulary, end_id=end_id, id_col=id_col, text_col=text_col)
    return read(docs.sparkSession, path, with_ids=with_ids)
