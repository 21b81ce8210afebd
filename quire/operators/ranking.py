"""Ranks, rank fusion and score normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.session import top_k


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position within each ranked list."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def collapse_chunks(hits: DataFrame, previews: int = 2, chars: int = 300) -> DataFrame:
    """Best chunk score per (query, paper) and the best chunks as previews.

    Hits per pair are counted in chunks of one paper, so the pair window stays small.
    """
    cut = F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit("..."))).otherwise(F.col("text"))
    few = top_k(hits.withColumn("text", cut), ["query_id", "paper_id"], [F.desc("score"), F.col("chunk_index")], previews, "n")
    # the first preview has the best score
    return few.groupBy("query_id", "paper_id").agg(
        F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("n", F.round("score", 3).alias("score"), "chunk_index", "section", "text"))).alias("chunks"))


def min_max(df: DataFrame, by: list[str], score: str = "score", name: str = "score_norm") -> DataFrame:
    """Scores scaled to 0..1 per list; a constant list becomes 1."""
    ends = df.groupBy(*by).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    share = (F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low"))
    out = df.join(ends, by)
    return out.withColumn(name, F.when(F.col("_high") == F.col("_low"), F.lit(1.0)).otherwise(share)).drop("_low", "_high")


def section_at(positions: DataFrame, headers: DataFrame) -> DataFrame:
    """Last header at or before each position of the same document."""
    rows = positions.select("doc_id", "pos", F.lit(1).alias("_k"), F.lit(None).cast("string").alias("header"))
    rows = rows.unionByName(headers.select("doc_id", "pos", F.lit(0).alias("_k"), "header"))
    w = Window.partitionBy("doc_id").orderBy("pos", "_k").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("section", F.last("header", ignorenulls=True).over(w))
    return out.filter("_k = 1").select("doc_id", "pos", "section")


def decayed(rank: Column, start: float = 0.9, step: float = 0.01) -> Column:
    """Score falling with the 1-based position."""
    return F.lit(start) - (rank - 1) * step


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = 60, limit: int | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of (query_id, doc_id, rank) lists.

    Weights are normalised.  Ties keep the order in which a document first appears:
    earliest list, then position in it.
    """
    weights = weights or [1.0] * len(lists)
    total = sum(weights)
    parts = [
        d.select("query_id", "doc_id", (F.lit(w / total) / (k + F.col("rank"))).alias("part"),
                 F.struct(F.lit(i).alias("list_no"), F.col("rank").alias("rank")).alias("seen"))
        for i, (d, w) in enumerate(zip(lists, weights))
    ]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(
        F.sum("part").alias("score"), F.min("seen").alias("_seen"))
    order = [F.desc(F.round("score", 12)), F.col("_seen.list_no"), F.col("_seen.rank")]
    return top_k(fused, ["query_id"], order, limit, "rank").drop("_seen")


def rerank(hits: DataFrame, pair_scores: DataFrame, k: int | None = None) -> DataFrame:
    """Hits re-ordered by a supplied (query_id, doc_id, pair_score) table.

    ``hits`` carries ``rank``; it becomes ``original_rank``.  Pairs without a score keep
    their place after the scored ones.
    """
    out = hits.withColumnRenamed("rank", "original_rank").join(pair_scores, ["query_id", "doc_id"], "left")
    out = out.withColumnRenamed("pair_score", "rerank_score")
    order = [F.desc_nulls_last("rerank_score"), F.col("original_rank")]
    return top_k(out, ["query_id"], order, k, "new_rank")
