"""Incremental maintenance of the postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators.textindex import build_index
from quire.session import top_k


def latest(changes: DataFrame) -> DataFrame:
    """Last change per document of a batch (op: insert, update, delete)."""
    return top_k(changes, ["id"], [F.desc("version")], 1)


def apply_batch(root: str, changes: DataFrame, batch_id: int, weights: dict[str, float]) -> None:
    """One micro-batch, append only: its postings, then the ids it changed.

    Earlier postings of a changed or deleted document are outdated by the change list, so a
    batch costs what it holds and never rewrites the table.  A replayed batch overwrites
    its own two folders; postings without their change list are not visible.
    """
    last = latest(changes)
    postings = build_index(last.filter("op <> 'delete'"), weights).postings
    postings.write.mode("overwrite").parquet(f"{root}/postings/batch={batch_id}")
    last.select(F.col("id").alias("doc_id"), "version").write.mode("overwrite").parquet(f"{root}/changed/batch={batch_id}")


def read_postings(spark: SparkSession, root: str) -> DataFrame:
    """Current postings: those of the highest version of their document, of equal versions the last batch.

    A change that arrives late, behind a newer version of its document, changes nothing.  Document frequencies are counted from these, never incremented.
    """
    last = spark.read.parquet(f"{root}/changed").groupBy("doc_id").agg(F.max(F.struct("version", "batch")).alias("top"))
    last = last.select("doc_id", F.col("top.batch").alias("batch"))
    return spark.read.parquet(f"{root}/postings").join(last, ["doc_id", "batch"]).drop("batch")


def compact(spark: SparkSession, root: str, target: str) -> None:
    """Current postings as the first batch of a new folder."""
    rows = read_postings(spark, root)
    rows.write.mode("overwrite").parquet(f"{target}/postings/batch=-1")
    kept = spark.read.parquet(f"{root}/changed").groupBy("doc_id").agg(F.max("version").alias("version"))  # deletions too: late changes must not undo them
    kept.write.mode("overwrite").parquet(f"{target}/changed/batch=-1")


def run(changes: DataFrame, root: str, checkpoint: str, weights: dict[str, float], trigger: dict | None = None,
        first_batch: int = 0):
    """Start the maintenance of a change stream (id, op, version and the indexed fields).

    A stream with a new checkpoint continues an existing index from ``first_batch``.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        apply_batch(root, batch, first_batch + batch_id, weights)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()
