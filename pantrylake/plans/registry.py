"""All queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aggregates, joins, kitchen, matching, more, rows, scalars, streams, wider, windows, wording  # noqa: F401  (each registers its queries)
from .base import ORACLES, QUERIES

FLAGSHIP = "QRY_05_category_spend"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
