"""Quality classifier: a sparse ensemble of rules over text statistics, scored as one Spark column expression.

1. Each text's statistics (shares of character classes, word and line measures) are computed over the whole text.
2. Shallow trees are boosted on a sample of labelled rows of at most ``MAX_ROWS`` (the smallest hashes of their ids).
   Every path from a root to a node is a rule: a conjunction of thresholds.
3. A logistic regression with a lasso penalty over the rules keeps few of them.
4. The kept rules and weights are compiled into a column expression, which scores all documents inside the JVM.

Defined cases: null text counts as empty; empty texts have all statistics zero and are scored like any other; a null
label, or one that is neither 0 nor 1, isn't learned from; of several labels of one document the smallest counts; rows
without an id are scored but never learned from; repeated rows get equal scores; without labels of both
classes every score is the share of label 1, or 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitweave.llm.common import map_arrow

#: Labelled rows that are learned from, at most.
MAX_ROWS = 12_000
STATS = (
    "log_chars", "log_words", "mean_word", "longest_word", "upper", "digit", "space", "newline", "stop_comma", "exclaim",
    "symbol", "pipe", "other_punct", "non_ascii", "control", "entropy", "distinct_words", "short_words", "caps_words",
    "edge_symbols", "repeated_lines", "mean_line", "top_word",
)


def _classes() -> np.ndarray:
    """(256, n): which bytes belong to each character class."""
    groups = [
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,", b"!", b"#$%&*@^~\\_=+<>{}[]", b"|",
        b"\"'()-/:;?`", bytes(range(128, 256)), bytes(range(10)) + bytes(range(11, 32)) + b"\x7f",
    ]
    out = np.zeros((256, len(groups)))
    for k, g in enumerate(groups):
        out[list(g), k] = 1
    return out


CLASSES = _classes()
SYMBOLS = tuple("#$%&*@^~\\_=+<>{}[]!|")


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of STATS per text."""
    texts = [t or "" for t in texts]
    out = np.zeros((len(texts), len(STATS)))
    if not texts:
        return out
    hist = np.stack([np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), minlength=256) for t in texts])
    n = np.maximum(hist.sum(1), 1)[:, None]
    upper, lower, digit, space, newline, stop, exclaim, symbol, pipe, other, high, control = (hist @ CLASSES / n).T
    share = hist / n
    entropy = -(share * np.log(np.where(share > 0, share, 1))).sum(1)
    letters = np.maximum(upper + lower + high, 1e-9)
    for k, t in enumerate(texts):
        words = t.split()
        w = max(len(words), 1)
        seen: dict[str, int] = {}
        for x in words:
            seen[x] = seen.get(x, 0) + 1
        lines = [x for x in t.split("\n") if x]
        lengths = [len(x) for x in words]
        out[k, 1:4] = math.log1p(len(words)), sum(lengths) / w, max(lengths, default=0)
        out[k, 16:] = (
            len(seen) / w,
            sum(x <= 3 for x in lengths) / w,
            sum(x.isupper() for x in seen) / max(len(seen), 1),
            sum(n for x, n in seen.items() if x.endswith(SYMBOLS)) / w,
            1 - len(set(lines)) / max(len(lines), 1),
            math.log1p(len(t) / max(len(lines), 1)),
            max(seen.values(), default=0) / w,
        )
        out[k, 0] = math.log1p(len(t))
    out[:, 4:16] = np.column_stack([upper / letters, digit, space, newline, stop, exclaim, symbol, pipe, other, high, control, entropy])
    # thresholds are compared in the JVM: a few digits are enough, and print alike on both sides
    return np.round(out, 6)


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and the STATS of each text."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = statistics(batch.column(len(keep)).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c) for c in stats.T)], [*keep, *STATS])

    return map_arrow(docs.select(*keep, text_col), run, f"{kinds}, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, greater than, threshold), all of which must hold


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            out += weight * holds(rule, x)
        return out

    def column(self) -> Column:
        """The score as a Spark expression over the STATS."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            test = F.lit(True)
            for k, above, cut in rule:
                test = test & ((F.col(STATS[k]) > cut) if above else (F.col(STATS[k]) <= cut))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float = 0.3, bins: int = 32) -> list[Rule]:
    """All paths of boosted regression trees on the logistic loss, each once."""
    cuts = [np.unique(np.round(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]), 6)) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    raw, rules = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        for _level in range(depth):
            split = []
            for rule, rows in nodes:
                best = None
                g, h = grad[rows], hess[rows]
                whole = g.sum() ** 2 / (h.sum() + 1)
                for k, c in enumerate(cuts):
                    b = binned[k, rows]
                    gl = np.cumsum(np.bincount(b, g, len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h, len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                    gain[(nl < 10) | (len(rows) - nl < 10)] = 0
                    if len(gain) and gain.max() > (best[0] if best else 1e-3):
                        at = int(gain.argmax())
                        best = (gain[at], k, float(c[at]))
                if best is None:
                    continue
                _, k, cut = best
                above = x[rows, k] > cut
                for side, mine in ((True, rows[above]), (False, rows[~above])):
                    split.append((_simplified((*rule, (k, side, cut))), mine))
                    rules[split[-1][0]] = None
            for _rule, rows in split:
                raw[rows] += rate / depth * grad[rows].sum() / (hess[rows].sum() + 1)
            nodes = split
    return list(rules)


def _simplified(rule: Rule) -> Rule:
    """One bound for each statistic and direction."""
    bounds: dict[tuple[int, bool], float] = {}
    for k, above, cut in rule:
        old = bounds.get((k, above), cut)
        bounds[k, above] = max(old, cut) if above else min(old, cut)
    return tuple(sorted((k, above, cut) for (k, above), cut in bounds.items()))


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 250) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient; r: 0/1 rules."""
    n = len(y)
    mean = r.mean(0)
    spread = np.maximum(np.sqrt(mean * (1 - mean)), 1e-3)
    z = ((r - mean) / spread).astype(np.float32)
    v = np.random.default_rng(0).standard_normal(z.shape[1]).astype(np.float32)
    for _ in range(15):
        v = z.T @ (z @ v)
        v /= max(float(np.linalg.norm(v)), 1e-12)
    step = 1 / (0.25 * max(float(np.linalg.norm(z @ v) ** 2) / n, 1e-6) * 1.05 + 0.25)
    w = np.zeros(z.shape[1])
    bias = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    look, look_bias, t = w, bias, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ look.astype(np.float32) + look_bias)))
        new = look - step * (z.T @ (p - y).astype(np.float32)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = look_bias - step * float((p - y).mean())
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look, look_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    w = w / spread
    return bias - float(w @ mean), w


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, penalty: float = 5e-4) -> RuleModel:
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(share / (1 - share)), ())
    rules = boosted_rules(x, y, trees, depth)
    r = np.stack([holds(rule, x) for rule in rules], 1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    bias, w = lasso_logistic(r, y, penalty)
    return RuleModel(bias, tuple((rule, float(v)) for rule, v in zip(rules, w, strict=True) if abs(v) > 1e-9))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    learn: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_ROWS,
) -> RuleModel:
    """``learn``: condition on the id for a label to be learned from."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.filter(learn) if learn is not None else known
    sample = (
        known.groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    # max_rows small rows: safe to broadcast
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    stats = with_statistics(found, ["_id", "_label"], "_text")
    rows = stats.groupBy("_id").agg(F.min("_label").alias("_label"), F.min(F.struct(*STATS)).alias("s")).select("_id", "_label", "s.*").toPandas()
    rows = rows.sort_values("_id")
    return fit(rows[list(STATS)].to_numpy(float), rows["_label"].to_numpy(float))


def score(docs: DataFrame, model: RuleModel, keep: list[str], *, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and score, one row per document."""
    return with_statistics(docs, keep, text_col).select(*keep, model.column().alias("score"))


def accepted(
    docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with its columns."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    renamed = docs.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(docs.columns)], F.col(text_col).alias("_text"))
    keep = [f"_{k}" for k in range(len(docs.columns))]
    scored = with_statistics(renamed, keep, "_text").filter(model.column() >= threshold)
    return scored.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])
