"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pairrank.session import prepare

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def register(builder: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")

        @wraps(builder)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return builder(prepare(spark), sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return builder

    return register
