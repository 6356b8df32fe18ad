"""Registration of named queries with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from veritrace.session import prepare
from veritrace.sources import sample

Loader = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(t)``, where ``t(name)`` loads a sample table or
    projection. ``sql`` may use the same names."""

    def register(fn: Callable[[Loader], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(partial(sample.load, prepare(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sample.with_projections(sql)
        return fn

    return register
