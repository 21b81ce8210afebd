"""Project registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SCHEMA = T.StructType([T.StructField("projects", T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("display_name", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("bib_file", T.StringType()), T.StructField("active", T.BooleanType()),
    T.StructField("topics", T.ArrayType(T.StringType())), T.StructField("focus", T.StringType()),
    T.StructField("relevance_hints", T.MapType(T.StringType(), T.StringType())),
])))])


def read_projects(spark: SparkSession, path: str, active_only: bool = True) -> DataFrame:
    """One row per project of a nested JSON registry; a missing flag means active."""
    out = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(F.inline("projects"))
    return out.filter(F.coalesce("active", F.lit(True))) if active_only else out
