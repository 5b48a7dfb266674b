"""Unsupervised record linkage (Fellegi-Sunter): match and non-match probabilities of agreement patterns by EM.

Patterns are counted by Spark; EM sees each distinct pattern of a settlement once, a few hundred at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Smoothing, rounds, tolerance, start of the anchor's probabilities, rows needed.
SMOOTHING, ROUNDS, TOLERANCE, ANCHOR_START, LEAST = 0.5, 200, 1e-7, (0.9, 0.1), 4


def fit(patterns: np.ndarray, counts: np.ndarray, expected: float | None = None) -> tuple[float, np.ndarray, np.ndarray] | None:
    """patterns: (n, fields) of 0/1, the first field being the anchor. Share of matches and, by field, the probability of
    agreement among matches and others. None if nothing identifies a match (no anchor, or too few rows)."""
    total = counts.sum()
    if total < LEAST or not (patterns[:, 0] * counts).sum():
        return None
    share = min(max((expected or (patterns[:, 0] * counts).sum()) / total, 1 / total), 0.5)
    m, u = np.full(patterns.shape[1], 0.7), np.full(patterns.shape[1], 0.3)
    m[0], u[0] = ANCHOR_START
    for _ in range(ROUNDS):
        a = share * np.prod(np.where(patterns == 1, m, 1 - m), 1)
        b = (1 - share) * np.prod(np.where(patterns == 1, u, 1 - u), 1)
        w = a / (a + b)
        k = w * counts
        new_m = ((patterns * k[:, None]).sum(0) + SMOOTHING) / (k.sum() + 2 * SMOOTHING)
        new_u = ((patterns * (counts - k)[:, None]).sum(0) + SMOOTHING) / ((counts - k).sum() + 2 * SMOOTHING)
        new_share = min(max(k.sum() / total, 1 / total), 0.5)
        moved = max(abs(new_m - m).max(), abs(new_u - u).max(), abs(new_share - share))
        m, u, share = new_m, new_u, new_share
        if moved < TOLERANCE:
            break
    return share, m, u


def weight(pattern: np.ndarray, m: np.ndarray, u: np.ndarray) -> float:
    return float(np.log2(np.where(pattern == 1, m / u, (1 - m) / (1 - u))).sum())


def posterior(bits: float, share: float) -> float:
    return 1 / (1 + 2 ** -max(-60.0, min(60.0, bits + math.log2(share / (1 - share)))))


def cohort(weights: np.ndarray, counts: np.ndarray, expected: float) -> np.ndarray:
    """Whole patterns by falling weight until they hold the expected members; positive weights only."""
    order = np.argsort(-weights, kind="stable")
    before = np.concatenate([[0], np.cumsum(counts[order])[:-1]])
    chosen = np.zeros(len(weights), bool)
    chosen[order[(before < expected) & (weights[order] > 0)]] = True
    return chosen


def posteriors(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """rows: ``by`` and 0/1 ``fields``, the anchor first. Per group and pattern: n, weight, posterior, in_cohort."""
    patterns = rows.groupBy(by, *fields).count().withColumnRenamed("count", "n")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(fields).reset_index(drop=True)
        p, n = pdf[fields].to_numpy(int), pdf.n.to_numpy(float)
        model = fit(p, n)
        if model is None:
            return pdf.iloc[:0].assign(weight=0.0, posterior=0.0, in_cohort=False)
        share, m, u = model
        w = np.array([weight(x, m, u) for x in p])
        return pdf.assign(weight=w.round(6), posterior=[round(posterior(x, share), 6) for x in w], in_cohort=cohort(w, n, max(float((p[:, 0] * n).sum()), 1.0)))

    kinds = ", ".join(f"{f} int" for f in fields)
    return patterns.groupBy(by).applyInPandas(run, f"{by} {rows.schema[by].dataType.simpleString()}, {kinds}, n bigint, weight double, posterior double, in_cohort boolean")
