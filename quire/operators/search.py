"""Composed searches: hybrid, smart, mode dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.operators import rewrite
from quire.operators.listing import to_result
from quire.operators.ranking import rerank, rrf
from quire.operators.retrieval import bm25, exact
from quire.operators.textindex import TextIndex
from quire.operators.vectors import knn
from quire.session import top_k

ALPHA, MIN_SIMILARITY = 0.65, 0.35


def semantic(query_vectors: DataFrame, vectors: DataFrame, docs: DataFrame | None = None, *, k: int = 20, min_score: float = MIN_SIMILARITY,
             year_min: int | None = None, year_max: int | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Vector hits as (query_id, doc_id, score, rank); the year range filters the vectors first.

    With ``chunks`` (chunk_id, paper_id, embedding) the best ``k`` chunks are found and a
    paper scores as its best chunk.
    """
    rows, key = (vectors, "id") if chunks is None else (chunks, "paper_id")
    if docs is not None and (year_min is not None or year_max is not None):
        low, high = year_min if year_min is not None else -9999, year_max if year_max is not None else 9999
        inside = docs.filter(F.col("year").between(low, high)).select(F.col("id").alias("_inside"))
        rows = rows.join(inside, rows[key] == F.col("_inside"), "left_semi")
    if chunks is None:
        return knn(query_vectors, rows, k, min_score=min_score).withColumnRenamed("id", "doc_id")
    hits = knn(query_vectors, rows.select(F.col("chunk_id").alias("id"), "embedding"), k, min_score=min_score)
    hits = hits.join(rows.select(F.col("chunk_id").alias("id"), F.col("paper_id").alias("doc_id")), "id")
    best = hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return top_k(best, ["query_id"], [F.desc("score"), F.col("doc_id")], k, "rank")


def result_rows(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """Hits as display rows: the paper's columns with a shortened abstract, score and rank."""
    rows = hits.select("query_id", F.col("doc_id").alias("id"), "score", "rank").join(papers.drop("score", "rank"), "id")
    return to_result(rows, F.col("score"))


def hybrid(queries: DataFrame, query_vectors: DataFrame, index: TextIndex, vectors: DataFrame, *, docs: DataFrame | None = None,
           k: int = 20, alpha: float = ALPHA, min_score: float = MIN_SIMILARITY, year_min: int | None = None,
           year_max: int | None = None, pair_scores: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """3k keyword and 3k vector hits fused by reciprocal rank; optional rerank by supplied scores.

    With ``chunks`` the vector side searches them and scores papers by their best chunk.
    """
    words = bm25(queries, index, docs=docs, year_min=year_min, year_max=year_max, k=3 * k)
    near = semantic(query_vectors, vectors, docs, k=3 * k, min_score=min_score, year_min=year_min, year_max=year_max, chunks=chunks)
    lists, weights = ([words, near], [1 - alpha, alpha]) if alpha > 0 else ([words], [1.0])
    out = rrf(lists, weights, limit=k)
    return out if pair_scores is None else rerank(out, pair_scores, k)


def smart(queries: DataFrame, query_vectors: DataFrame, index: TextIndex, vectors: DataFrame, **options) -> DataFrame:
    """Spelling and expansion on the keyword side, the original text's vector on the other."""
    fixed = queries.join(rewrite.correct_queries(queries, index.terms), "query_id", "left")
    fixed = fixed.select("query_id", F.coalesce("corrected", "query").alias("query"))
    grown = rewrite.term_groups(rewrite.expand_queries(fixed))
    words = grown.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("alternative")), " ").alias("query"))
    return hybrid(words, query_vectors, index, vectors, **options)


def search(queries: DataFrame, mode: str, *, docs: DataFrame, index: TextIndex, vectors: DataFrame | None = None,
           query_vectors: DataFrame | None = None, k: int = 20, **options) -> DataFrame:
    """One of ``smart``, ``hybrid``, ``semantic``, ``exact``, ``keyword``.

    Semantic search without vectors falls back to keywords and says so in ``fallback``.
    """
    tag = lambda df, used, fallback=None: df.withColumn("strategy", F.array(*[F.lit(s) for s in used])).withColumn(
        "fallback", F.lit(fallback).cast("string"))
    no_vectors = vectors is None or query_vectors is None
    if mode == "exact":
        out = exact(queries, docs, index, k=k, **options)
        return tag(out.drop("strategy", "tier"), ["exact"])
    if mode == "keyword" or (mode == "semantic" and no_vectors):
        out = bm25(queries, index, docs=docs, k=k, **options)
        return tag(out, ["keyword"], "no vectors, keyword search used" if mode == "semantic" else None)
    if mode == "semantic":
        return tag(semantic(query_vectors, vectors, docs, k=k, **options), ["semantic"])
    if mode in ("hybrid", "smart"):
        if no_vectors:
            out = bm25(queries, index, docs=docs, k=k, **options)
            return tag(out, ["keyword"], "no vectors, keyword search used")
        run = hybrid if mode == "hybrid" else smart
        return tag(run(queries, query_vectors, index, vectors, docs=docs, k=k, **options), ["keyword", "semantic"])
    raise ValueError(f"unknown search mode: {mode}")
