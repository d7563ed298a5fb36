"""Name -> (Spark query over the driver tables, SQL for another engine or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans.bridge import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Corpus], DataFrame], sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Corpus(spark, sf_dir))

    run.__name__ = name
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql
