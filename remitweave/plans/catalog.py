"""All registered queries of the settlement engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from remitweave.plans import compliance, functions, kernels, ledgers, merchants, registers, reviews, settlements, uploads

FLAGSHIP = settlements.flagship
_MODULES = (compliance, functions, kernels, ledgers, merchants, registers, reviews, settlements, uploads)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
