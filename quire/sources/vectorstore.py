"""Vector table on parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64


def _bucket():
    return F.pmod(F.xxhash64("paper_id"), F.lit(BUCKETS)).cast("int")


def flat_metadata(df: DataFrame) -> DataFrame:
    """Non-scalar metadata as text; nulls stay out of the map."""
    kinds = dict(df.dtypes)
    nested = [c for c, k in kinds.items() if c != "embedding" and k.startswith(("array", "map", "struct"))]
    out = df
    for c in nested:
        out = out.withColumn(c, F.to_json(c))
    return out


def write_vectors(df: DataFrame, path: str, mode: str = "replace") -> None:
    """Write vectors laid out by a bucket of the paper id.

    ``replace`` re-embeds by paper: buckets the new rows touch are rewritten with all other
    papers' vectors kept, the rest of the table is not read or written.
    """
    spark = df.sparkSession
    new = flat_metadata(df).withColumn("bucket", _bucket())
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    if mode == "replace" and exists:
        touched = new.select("bucket").distinct()
        old = spark.read.parquet(path).join(touched, "bucket", "left_semi")
        new = new.unionByName(old.join(new.select("paper_id").distinct(), "paper_id", "left_anti"), allowMissingColumns=True)
        from quire.session import checkpointed
        new = checkpointed(new)  # the files being replaced are an input
    rows = new.repartition("bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_vectors(spark: SparkSession, path: str, papers: DataFrame | None = None, where: str | None = None) -> DataFrame:
    """Vectors, optionally of some papers (``paper_id``) and under a pushed-down condition."""
    out = spark.read.parquet(path)
    if where is not None:
        out = out.filter(where)
    if papers is not None:
        out = out.join(papers.select("paper_id").withColumn("bucket", _bucket()).distinct(), ["bucket", "paper_id"], "left_semi")
    return out.drop("bucket")
