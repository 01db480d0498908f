"""The register of queries and their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from registry.views import Data, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Data], DataFrame], sql: str | None = None) -> None:
    """File ``build`` under ``name``; ``sql`` is the oracle over the tables and views."""
    QUERIES[name] = lambda spark, sf_dir: build(Data(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = with_views(sql)
