"""The registry of the library's own queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import indexing, registry, retrieval, scalars, streams, telemetry  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Each case's hybrid retrieval, expanded over the graph and packed under the token budget."""
    return retrieval.pack_context(spark, folder)
