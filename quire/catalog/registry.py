"""Registry of the queries the package offers on the driver tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.catalog.standins import VIEWS, expand

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
       "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Tables:
    """Driver tables and the library views defined on them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in VIEWS:
            sql, needs = VIEWS[name]
            frames = {n: getattr(self, n) for n in needs}
            for n in needs:
                sql = sql.replace(f"@{n}", "{" + n + "}")
            return self.spark.sql(sql, **frames)
        raise AttributeError(name)


def query(name: str, sql: str | None = None, needs: str = ""):
    """Register a query.  ``needs`` names the library views its SQL reads."""

    def add(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = expand(sql, needs.split())
        return fn

    return add
