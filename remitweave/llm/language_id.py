"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: counts of the 1- to 3-grams of a whole text's lower-cased letters (runs of anything else are one space), hashed
  to 2**BITS places, as log(1 + count) times the inverse document frequency, scaled to length 1. Document frequencies are
  counted over all rows that may be learned from. Beyond 2**CELLS / 2**BITS = 256 languages there are fewer places, so that the
  weights, places x languages, stay within 2**CELLS numbers.
* Training: follow-the-regularised-leader (proximal) with an elastic-net penalty, on at most ``PER_LANGUAGE``
  documents of each language and ``DOCUMENTS`` of all, in equal parts (those with the smallest hashes of their ids), and on short
  snippets of them. Every language with a labelled row is learned, and whole texts of any length: the executors turn them into
  features, of which at most ``ENTRIES``, in equal parts for the languages, and one document of each language come to the driver.
  The language column is taken to hold codes, of which the world has some 8,000.
* Calibration: every fifth of these documents is kept from training, and a temperature is fitted on it.

Defined cases: null text, and text without a letter, is ``und`` with score 0; so is every text if nothing may be
learned from; rows without an id are predicted, not learned from; repeated ids are learned from once; repeated
rows get equal results; of languages with equal scores the first by name is taken; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remitweave.llm.common import map_arrow, materialise

BITS, CELLS = 16, 24
PER_LANGUAGE, DOCUMENTS, ENTRIES = 900, 57_600, 32_000_000
UNKNOWN = "und"
#: Characters that a snippet for training has.
SNIPPETS = (24, 80)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which characters are letters."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def places(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature places (ascending, of 2**bits) and their counts; none if the text has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.where(is_letter, codes, 32).astype(np.uint64)
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    padded = np.concatenate([[np.uint64(32)], codes, [np.uint64(32)]])
    with np.errstate(over="ignore"):
        one = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        c = (padded + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
        two = (c[:-1] ^ (c[1:] >> np.uint64(7))) * np.uint64(0x165667B19E3779F9)
        three = (two[:-1] ^ (c[2:] >> np.uint64(13))) * np.uint64(0x27D4EB2F165667C5)
        h = np.concatenate([one, two, three]) >> np.uint64(64 - bits)
    counts = np.bincount(h.astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # (places, languages)
    temperature: float = 1.0

    def values(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Feature values of counts ``n`` at the places ``at``."""
        x = np.log1p(n, dtype=np.float64) * self.idf[at]
        size = math.sqrt(float(x @ x))
        return x / size if size else x

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray | None:
        return self.values(at, n) @ self.weights[at] if len(at) else None

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(*places(text, len(self.idf).bit_length() - 1)) if self.languages else None
        if z is None:
            return UNKNOWN, 0.0
        p = softmax(z / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


#: Places and counts of a text.
Example = tuple[np.ndarray, np.ndarray]


def ftrl(model: LanguageModel, examples: list[Example], classes: list[int], *, epochs: int = 2, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
    """Fit ``model.weights`` in place."""
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            at, counts = examples[k]
            if not len(at):
                continue
            x = model.values(at, counts)
            zs, ns = z[at], n[at]
            w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))
            p = softmax(x @ w)
            p[classes[k]] -= 1
            g = x[:, None] * p
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[at] = more
    model.weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def calibrated(model: LanguageModel, examples: list[Example], classes: list[int]) -> float:
    """The temperature with the least negative log likelihood, by golden section on its logarithm."""
    pairs = [(z, c) for e, c in zip(examples, classes, strict=True) if (z := model.logits(*e)) is not None]
    if not pairs:
        return 1.0

    def loss(log_t: float) -> float:
        t = math.exp(log_t)
        return -sum(math.log(max(float(softmax(z / t)[c]), 1e-12)) for z, c in pairs)

    a, b, g = math.log(0.05), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(30):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def document_frequencies(texts: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """Rows of the only column ``text`` that hold each feature, and rows that hold any. 2**bits numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((1 << bits) + 1, np.int64), 0
        for b in batches:
            for k in range(0, b.num_rows, 512):
                for t in b.column(0).slice(k, 512).to_pylist():
                    at, _ = places(t, bits)
                    df[at] += 1
                    n += len(at) > 0
        df[1 << bits] = n
        (at,) = np.nonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["place", "n"])

    rows = texts.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros((1 << bits) + 1, np.int64)
    df[rows["place"].to_numpy(int)] = rows["n"].to_numpy(int)
    return df[:-1], int(df[-1])


def examples(texts: DataFrame, bits: int) -> DataFrame:
    """texts: lang, _r, _h, text. Of each whole text and of snippets of it: lang, _r, part, the places (16 bits each), their counts (32 bits each) and how many they are."""
    sizes = SNIPPETS
    kind = texts.schema["lang"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, part, at, n = [], [], [], []
        for k, (h, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            text = text or ""
            starts = [(h * 7919 % (len(text) - size), size) for size in sizes if len(text) > 2 * size]
            for p, some in enumerate([text, *(text[s : s + size] for s, size in starts)]):
                where, counts = places(some, bits)
                row.append(k)
                part.append(p)
                at.append(where.astype(np.uint16).tobytes())
                n.append(counts.astype(np.uint32).tobytes())
        kept = batch.select([0, 1]).take(pa.array(row, pa.int64()))
        columns = [*kept.columns, pa.array(part, pa.int32()), pa.array(at, pa.binary()), pa.array(n, pa.binary()), pa.array([len(x) // 2 for x in at], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "_r", "part", "places", "counts", "size"])

    return map_arrow(texts.select("lang", "_r", "_h", "text"), run, f"lang {kind}, _r int, part int, places binary, counts binary, size bigint", rows=64)


def train(docs: DataFrame, *, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """``learn``: condition for a row to be learned from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (learn if learn is not None else F.lit(True)).alias("_learn"))
    rows = rows.filter(F.col("_learn") & F.col("lang").isNotNull()).drop("_learn")
    ids = rows.filter(F.col("id").isNotNull()).select("id", "lang").distinct()
    counted = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).collect()  # a row for each language
    languages = tuple(sorted(r["lang"] for r in counted))
    share = max(len(languages), 1)
    bits = min(BITS, max(8, CELLS - (share - 1).bit_length()))
    df, n = document_frequencies(rows.select("text"), bits)
    model = LanguageModel(languages, np.log((1 + n) / (1 + df)) + 1.0, np.zeros((1 << bits, share)))
    if not languages:
        return model
    most = min(PER_LANGUAGE, max(1, DOCUMENTS // share))
    sizes = docs.sparkSession.createDataFrame(counted, f"lang {rows.schema['lang'].dataType.simpleString()}, _n bigint")
    order = Window.partitionBy("lang").orderBy("_h", "id")
    # hashes up to where about four times the wanted number lie, by each language's count of ids: the window then sorts few rows
    # of even a language that holds most of the corpus
    chosen = (
        ids.withColumn("_h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
        .join(F.broadcast(sizes), "lang")  # a row for each language
        .filter(F.col("_h") * F.col("_n").cast("double") < float(max(4 * most, 64) << 30))
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= most)
        .select("id", "lang", "_h", "_r")
    )
    # DOCUMENTS ids, or one for each language: safe to broadcast
    texts = rows.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang", "_h", "_r").agg(F.min("text").alias("text"))
    made = materialise(examples(texts, bits))
    sums = F.sum("size").over(Window.partitionBy("lang").orderBy("_r", "part"))
    within = made.select("lang", "_r", "part", sums.alias("_sum")).filter((F.col("_sum") <= ENTRIES // share) | (F.col("_r") == 1)).drop("_sum")
    sample = made.drop("size").join(F.broadcast(within), ["lang", "_r", "part"]).toPandas().sort_values(["lang", "_r", "part"])  # at most three for each of the ids
    fit_x, fit_y, held_x, held_y = [], [], [], []
    number = {x: k for k, x in enumerate(languages)}
    for lang, r, at, counts in zip(sample["lang"], sample["_r"], sample["places"], sample["counts"], strict=True):
        to_x, to_y = (held_x, held_y) if r % 5 == 0 else (fit_x, fit_y)
        to_x.append((np.frombuffer(at, np.uint16), np.frombuffer(counts, np.uint32)))
        to_y.append(number[lang])
    ftrl(model, fit_x, fit_y)
    model.temperature = calibrated(model, held_x, held_y)
    return model


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], *, text_col: str = "text") -> DataFrame:
    """Columns ``keep``, lang_pred and score, one row per document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [held.value.predict(t) for t in batch.column(len(keep)).to_pylist()]
        cols = [*batch.columns[: len(keep)], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
        return pa.RecordBatch.from_arrays(cols, [*keep, "lang_pred", "score"])

    return map_arrow(docs.select(*keep, text_col), run, f"{kinds}, lang_pred string, score double")
