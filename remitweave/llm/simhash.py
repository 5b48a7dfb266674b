"""Near-duplicates by SimHash: tiled exact comparison of fingerprints with numpy's exclusive-or and bit counts.

Each distinct fingerprint takes part once. Two fingerprints within ``radius`` bits agree wholly in one of
radius + 1 ranges of bits, so fingerprints are dealt to *blocks* by the bits of each range; no link can lie
outside a block, and none is lost. For a radius too large for that, blocks are documents with a least shingle in common
under one of ``KEYS`` hash functions: two texts with Jaccard similarity s share none of them with probability
(1 - s)**KEYS, 3e-6 at 0.8. So work grows with the documents, not with their pairs. A block is ordered by population
count and cut into tiles of at most ``tile`` fingerprints. Tile pairs whose population counts (and, with
``min_ratio``, shingle counts) differ beyond what a link allows are skipped; the others go to tasks of
their own, so that a large block is shared among many tasks. From a tile pair only links that join two of its
groups so far come back, fewer than it has fingerprints.

With ``min_jaccard``, fingerprints are those of the distinct shingles, and close ones are candidates only: a link needs that
Jaccard similarity of the two sets of shingles. Texts with one fingerprint but other shingles are then parted as well. The sets
are made, and shuffled, only for documents that have a candidate: groups of candidates are the blocks of a second comparison.

Defined cases: null text counts as empty; a text without words has fingerprint zero, linked like any other; one with
fewer words than a shingle has its whole word sequence as its only shingle; repeated rows share a class;
null identifiers follow all others when the smallest is taken; rows with one identifier are one document for ``survivors``, which
stay or go together; an empty table gives an empty result; other columns are ignored, and ``survivors`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitweave.llm.common import flag_by_bits, fresh, id_bits, map_arrow, materialise
from remitweave.llm.components import components

#: Fingerprints to a tile, and shingles that count as one more where sets of shingles are compared.
TILE, UNIT = 2048, 512
#: Least shingles by which texts are dealt to blocks, for wide radii.
KEYS = 8
#: Added to a hash before mixing, for each further 64 bits of a wide fingerprint.
GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(text: str | None, words_each: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of words (A-Z lower-cased, parted by U+0020 and U+0009 to U+000D), repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(words_each, len(words))
    starts, stops = [0, *ends[: len(words) - k].tolist()], (ends[k - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)


def widen(h: np.ndarray, parts: int) -> np.ndarray:
    """(parts, n): the hashes, and independent ones mixed from them."""
    out = [h]
    with np.errstate(over="ignore"):
        for i in range(1, parts):
            z = h + np.uint64(GOLDEN * i & 0xFFFFFFFFFFFFFFFF)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out.append(z ^ (z >> np.uint64(31)))
    return np.stack(out)


def least_hashes(h: np.ndarray) -> list[int]:
    """The smallest hash under each of KEYS functions, as signed 64-bit numbers."""
    if not len(h):
        return [0]
    return widen(h, KEYS + 1)[1:].min(1).view(np.int64).tolist()


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 255):  # so that 8 bits hold a sum
        bits = np.unpackbits(h[at : at + 255].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprint(text: str | None, words_each: int = 3, parts: int = 1, seed: int = 42) -> tuple[list[int], int]:
    """The fingerprint's 64-bit words and the number of shingles."""
    h = shingle_hashes(text, words_each, seed)
    return [majority(x) for x in widen(h, parts)], len(h)


def fingerprints(
    docs: DataFrame, *, words_each: int = 3, parts: int = 1, sets: bool = False, with_shingles: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, fp (hex of ``parts`` 64-bit words), n_shingles, keys (least shingles; for wide fingerprints only).

    ``sets``: of distinct shingles; fp also has ':' and a hash of the set, and with ``with_shingles`` a column ``shingles`` has their
    sorted hashes.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, words_each) for t in batch.column(1).to_pylist()]
        hashes = [np.unique(h) for h in hashes] if sets else hashes
        fps = ["".join(f"{majority(x):016x}" for x in widen(h, parts)) for h in hashes]
        keys = [least_hashes(h) if parts > 1 else [] for h in hashes]
        raw = [h.tobytes() for h in hashes] if sets else []
        fps = [f"{f}:{xxhash.xxh64_hexdigest(x)}" for f, x in zip(fps, raw, strict=True)] if sets else fps
        columns = [batch.column(0), pa.array(fps, pa.string()), pa.array([len(h) for h in hashes], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, *([pa.array(raw, pa.binary())] if with_shingles else [])], ["id", "fp", "n_shingles", "keys", *["shingles"] * with_shingles])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"id {kind}, fp string, n_shingles bigint, keys array<bigint>" + ", shingles binary" * with_shingles)


def words_of(fps: list[str]) -> np.ndarray:
    """(n, parts) unsigned 64-bit words of hex fingerprints."""
    return np.frombuffer(bytes.fromhex("".join(fps)), ">u8").astype(np.uint64).reshape(len(fps), -1) if fps else np.zeros((0, 1), np.uint64)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b that differ in at most ``radius`` bits."""
    left, right = [], []
    for at in range(0, len(a), 256):
        d = np.bitwise_count(a[at : at + 256, None, 0] ^ b[None, :, 0])
        if a.shape[1] == 1:
            i, j = np.nonzero(d <= radius)
        else:
            d = d + np.bitwise_count(a[at : at + 256, None, 1] ^ b[None, :, 1])
            i, j = np.nonzero(d <= radius)
            total = d[i, j].astype(np.int64)
            for w in range(2, a.shape[1]):
                total += np.bitwise_count(a[at + i, w] ^ b[j, w])
            i, j = i[total <= radius], j[total <= radius]
        left.append(i + at)
        right.append(j)
    return np.concatenate(left) if left else np.zeros(0, int), np.concatenate(right) if right else np.zeros(0, int)


class Groups:
    """Union-find over the rows of a tile pair."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class Sets:
    """Sets of shingles, as the bytes of their hashes."""

    def __init__(self, raw: list[bytes]):
        held = [np.frombuffer(x, np.uint64) for x in raw]
        values, ids = np.unique(np.concatenate(held), return_inverse=True)
        self.ids = np.split(ids, np.cumsum([len(x) for x in held])[:-1])
        self.mark = np.zeros(len(values), bool)

    def alike(self, p: int, others: list[int], least: float) -> list[int]:
        """Those of ``others`` whose Jaccard similarity to p is ``least`` at least."""
        others = [q for q in others if len(self.ids[q])]
        if not others or not len(self.ids[p]):
            return []
        sizes = np.array([len(self.ids[q]) for q in others])
        self.mark[self.ids[p]] = True
        both = np.add.reduceat(self.mark[np.concatenate([self.ids[q] for q in others])].astype(np.int64), np.cumsum(sizes) - sizes)
        self.mark[self.ids[p]] = False
        return [q for q, ok in zip(others, both / (sizes + len(self.ids[p]) - both) >= least, strict=True) if ok]


def tile_links(
    fps: list[str], sizes: np.ndarray, tiles: np.ndarray, radius: int, min_ratio: float, shingles: list[bytes] | None = None, min_jaccard: float = 0.0
) -> list[tuple[str, str]]:
    """Links of one tile with itself (one value in ``tiles``) or of two tiles with each other."""
    words = words_of([f.partition(":")[0] for f in fps])
    sets = Sets(shingles) if shingles else None
    first = np.flatnonzero(tiles == tiles.min())
    second = np.flatnonzero(tiles != tiles.min()) if tiles.min() != tiles.max() else first
    groups, out = Groups(len(fps)), []
    order = np.argsort(np.bitwise_count(words[second]).sum(1, dtype=np.int64), kind="stable")
    second = second[order]
    # signed: less the radius they may be negative
    counts = np.bitwise_count(words[second]).sum(1, dtype=np.int64)
    mine = np.bitwise_count(words[first]).sum(1, dtype=np.int64)
    for at in np.argsort(mine, kind="stable").reshape(-1, 1) if len(first) < 64 else np.array_split(np.argsort(mine, kind="stable"), len(first) // 64):
        rows = first[at]
        lo, hi = np.searchsorted(counts, [mine[at].min() - radius, mine[at].max() + radius + 1])
        near = second[lo:hi]
        i, j = close_pairs(words[rows], words[near], radius)
        x, y = rows[i], near[j]
        fit = (x != y) & (np.minimum(sizes[x], sizes[y]) >= min_ratio * np.maximum(sizes[x], sizes[y]))
        if sets:
            x, y = x[fit], y[fit]
            for k in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1) if len(x) else []:
                p = int(x[k[0]])
                # those already in p's group need no link
                for q in sets.alike(p, [q for q in y[k].tolist() if groups.root(q) != groups.root(p)], min_jaccard):
                    if groups.join(p, q):
                        out.append((fps[p], fps[q]))
            continue
        for p, q in zip(x[fit].tolist(), y[fit].tolist(), strict=True):
            if groups.join(p, q):
                out.append((fps[p], fps[q]))
    return out


def _streamed(radius: int, min_ratio: float, min_jaccard: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks that are one tile each, many to a task; rows come block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found() -> list[tuple[str, str]]:
            if len(held) < 2:
                return []
            sizes = np.array([x[2] for x in held])
            return tile_links([x[1] for x in held], sizes, np.zeros(len(held), int), radius, min_ratio, [x[3] for x in held] if min_jaccard else None, min_jaccard)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    out += found()
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["a", "b"])
        out = found()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["a", "b"])

    return run


def with_ones(distinct: DataFrame, parts: int) -> DataFrame:
    """``distinct`` with the bits of fp as text, and how many are set."""
    bits = F.concat(*[F.lpad(F.conv(F.substring("fp", 16 * i + 1, 16), 16, 2), 64, "0") for i in range(parts)])
    return distinct.withColumn("bits", bits).withColumn("ones", F.length(F.replace("bits", F.lit("0"), F.lit(""))))


def sized(rows: DataFrame) -> DataFrame:
    """Rows of blocks of more than one, with their blocks' ``total`` of units."""
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("total")).filter("n > 1").drop("n")
    return rows.join(sizes, "block")


def links(distinct: DataFrame, *, radius: int, parts: int = 1, min_ratio: float = 0.0, tile: int = TILE) -> DataFrame:
    """(a, b): enough links among fingerprints to join all that are within ``radius`` in a block. ``distinct``: fp, n_shingles, and
    keys, by which blocks are made if the radius leaves ranges of less than 8 bits (without keys there is one block)."""
    total = 64 * parts
    n_ranges = radius + 1 if total // (radius + 1) >= 8 else 1
    cuts = [total * i // n_ranges for i in range(n_ranges + 1)]
    ranges = F.array(
        *[F.concat(F.lit(f"{i}:"), F.substring("bits", a + 1, b - a) if n_ranges > 1 else F.lit("")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    )
    by_key = n_ranges == 1 and "keys" in distinct.columns
    numbered = F.transform("keys", lambda x, i: F.concat_ws(":", i, x)) if by_key else None
    blocks = F.when(F.size("keys") > 0, numbered).otherwise(ranges) if by_key else ranges
    rows = with_ones(distinct, parts).select(F.explode(blocks).alias("block"), "fp", "n_shingles", "ones", F.lit(1).cast("bigint").alias("units"))
    return block_links(materialise(sized(rows)), radius, min_ratio, tile)


def block_links(rows: DataFrame, radius: int, min_ratio: float, tile: int, min_jaccard: float = 0.0) -> DataFrame:
    """Links within blocks. ``rows``: a written table of block, fp, n_shingles, ones, units, total, and for ``min_jaccard`` shingles."""
    small = rows.filter(F.col("total") <= tile).select("block", "fp", "n_shingles", *["shingles"] * (min_jaccard > 0))
    found = small.repartition("block").sortWithinPartitions("block").mapInArrow(_streamed(radius, min_ratio, min_jaccard), "a string, b string")
    large = rows.filter(F.col("total") > tile)
    return found if large.isEmpty() else found.unionByName(_tile_pairs(large, radius, min_ratio, tile, min_jaccard))


def _tile_pairs(large: DataFrame, radius: int, min_ratio: float, tile: int, min_jaccard: float) -> DataFrame:
    """A large block's fingerprints are cut into cells of like (shingle count, population count), a cell into parts of at most ``tile``
    units; tiles are consecutive cells gathered to so many. Each tile pair that may hold a link is a group."""
    level = F.floor(F.log2(F.greatest(F.col("n_shingles"), F.lit(1))) / F.lit(0.25)) if min_ratio > 0 else F.lit(0).cast("long")
    spread = large.withColumn("level", F.struct(level.alias("level"), "ones"))
    counted = spread.groupBy("block", "level").agg(F.sum("units").alias("m"))
    spread = spread.join(counted, ["block", "level"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("m") / F.lit(tile))).cast("int"))
    cells = spread.groupBy("block", "level", "part").agg(
        F.sum("units").alias("m"), F.min("ones").alias("lo"), F.max("ones").alias("hi"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most")
    )
    before = F.sum("m").over(_ordered())
    numbered = materialise(cells.withColumn("tile", F.floor((before - 1) / F.lit(tile)).cast("int")))
    tiles = numbered.groupBy("block", "tile").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("least").alias("least"), F.max("most").alias("most"))
    x, y = tiles.alias("x"), tiles.alias("y")
    pairs = x.join(
        y,
        (F.col("x.block") == F.col("y.block"))
        & (F.col("x.tile") <= F.col("y.tile"))
        & (F.col("y.lo") <= F.col("x.hi") + radius)
        & (F.col("x.lo") <= F.col("y.hi") + radius)
        & (F.col("y.most") >= min_ratio * F.col("x.least"))
        & (F.col("x.most") >= min_ratio * F.col("y.least")),
    ).select("x.block", F.col("x.tile").alias("i"), F.col("y.tile").alias("j"))
    needed = pairs.select("block", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    rows = spread.join(numbered.select("block", "level", "part", "tile"), ["block", "level", "part"]).select("block", "tile", "fp", "n_shingles", *["shingles"] * (min_jaccard > 0))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp")
        found = tile_links(pdf.fp.tolist(), pdf.n_shingles.to_numpy(), pdf.tile.to_numpy(), radius, min_ratio, pdf.shingles.tolist() if min_jaccard else None, min_jaccard)
        return pd.DataFrame(found, columns=["a", "b"])

    return rows.join(needed, ["block", "tile"]).groupBy("block", "i", "j").applyInPandas(compare, "a string, b string")


def _ordered():
    from pyspark.sql import Window

    return Window.partitionBy("block").orderBy("level", "part").rowsBetween(Window.unboundedPreceding, 0)


def near_duplicates(
    docs: DataFrame,
    *,
    words_each: int = 3,
    radius: int = 2,
    parts: int = 1,
    min_ratio: float = 0.0,
    min_jaccard: float = 0.0,
    tile: int = TILE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: id, fp, component_id (the smallest identifier reachable over links, itself included).

    ``parts``: fingerprint length in 64-bit words. ``min_ratio``: two documents link only if the smaller has that
    share of the larger one's shingles. ``min_jaccard``: they link only if their sets of shingles are that alike.
    """
    made = {"words_each": words_each, "parts": parts, "sets": min_jaccard > 0, "id_col": id_col, "text_col": text_col}
    rows = materialise(fingerprints(docs, **made))
    # one row per fingerprint: of several texts that of fewest shingles stands for all, as they are linked in any case
    distinct = materialise(
        rows.groupBy("fp")
        .agg(F.min(F.struct("n_shingles", "keys")).alias("s"), F.min("id").alias("least"))
        .select("fp", "s.n_shingles", "s.keys", "least")
    )
    roots = components(links(distinct.select("fp", "n_shingles", "keys"), radius=radius, parts=parts, min_ratio=min_ratio, tile=tile))
    if min_jaccard > 0:
        units = (F.lit(1) + F.floor(F.col("n_shingles") / UNIT)).cast("bigint")
        groups = distinct.join(roots, distinct["fp"] == roots["node"]).select(F.col("root").alias("block"), "fp", "n_shingles", units.alias("units"), "least")
        groups = materialise(sized(with_ones(groups, parts).drop("bits")))
        rows_of = _shingles_of(docs, groups, made)
        roots = components(block_links(materialise(groups.drop("least").join(rows_of, "fp")), radius, min_ratio, tile, min_jaccard))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("id", F.substring_index("fp", ":", 1).alias("fp"), "component_id")


def _shingles_of(docs: DataFrame, groups: DataFrame, made: dict, log2_bits: int = 24) -> DataFrame:
    """fp and shingles of the fingerprints in ``groups``, from the documents with their least identifiers, which a bit filter finds."""
    bits = materialise(id_bits(groups, F.col("least"), log2_bits))
    name = fresh(docs, "_maybe")
    maybe = flag_by_bits(docs, F.col(made["id_col"]), bits, log2_bits, name).filter(F.col(name))
    found = fingerprints(maybe, with_shingles=True, **made).select("fp", "shingles")
    return found.join(groups.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles"))


def survivors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", log2_bits: int = 24, **parameters) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id. Columns as in ``docs``.

    Documents alone in their component pass without a shuffle: a bit filter of fixed size over the ids that go
    tells which ones need the exact join.
    """
    found = materialise(near_duplicates(docs, id_col=id_col, text_col=text_col, **parameters))
    gone = found.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select("id").distinct()
    bits = materialise(id_bits(gone, F.col("id"), log2_bits))
    name = fresh(docs, "_maybe")
    flagged = flag_by_bits(docs, F.col(id_col), bits, log2_bits, name)
    maybe = flagged.filter(name).drop(name)
    stay = maybe.join(gone, maybe[id_col].eqNullSafe(gone["id"]), "left_anti")
    return flagged.filter(~F.col(name)).drop(name).unionByName(stay)
