"""TeX corpora: recursive line source and citation scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CITE = r"\\(?:cite|citep|citet|citeyear|citeauthor)\{([^}]+)\}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.tex").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), "value")


def text_lines(files: DataFrame) -> DataFrame:
    """file, line (from 1), text."""
    rows = files.select("file", F.posexplode(F.split("value", "\n")).alias("n", "text"))
    return rows.select("file", (F.col("n") + 1).alias("line"), "text")


def tex_citations(lines: DataFrame, pattern: str = CITE) -> DataFrame:
    """One row per cited key: key, file, line, first 100 characters of the line."""
    found = lines.select("file", "line", "text", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("group"))
    found = found.withColumn("key", F.explode(F.split("group", ",")))
    return found.select(F.trim("key").alias("key"), "file", "line", F.substring(F.trim("text"), 1, 100).alias("context"))


def citation_counts(citations: DataFrame) -> DataFrame:
    """Occurrences and files per key."""
    return citations.groupBy("key").agg(F.count("*").alias("occurrences"), F.count_distinct("file").alias("files"))
