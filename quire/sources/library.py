"""Library tables on parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.schemas import LIBRARY


def read_library(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """All library relations under their declared schemas (no inference, column pruning stays free)."""
    return {n: spark.read.schema(LIBRARY[n]).parquet(f"{folder}/{n}.parquet") for n in names or LIBRARY}
