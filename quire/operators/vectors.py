"""Nearest vectors by cosine, exact."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quire.operators.ranking import collapse_chunks
from quire.session import top_k

#: Rows of either side that meet in one task, as many as they grow to in large tables, and queries that are multiplied there at once.
BLOCK, WIDE, ROWS = 4096, 1 << 15, 256


def _unit(rows) -> np.ndarray:
    m = np.array(list(rows), dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, floor: float | None, no_self: bool, rows: int = ROWS) -> pd.DataFrame:
    """The k best columns of each row of one block, ties by id; ``rows`` rows meet at most ``BLOCK`` columns at a time.

    The columns come in the order of their ids, so one that does not pass the k-th score so far is out at once.
    """
    order = np.argsort(vid, kind="stable")
    v, vid, out = v[order], vid[order], []
    odd = not (np.isfinite(q).all() and np.isfinite(v).all())
    least = -np.inf if floor is None else floor - 6e-7  # before rounding
    for at in range(0, len(q), rows):
        own, x = qid[at:at + rows], q[at:at + rows]
        bar = np.full(len(own), least)
        r, c, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        to, wide = 0, max(512, 2 * k)
        while to < len(v):
            sims = x @ v[to:to + wide].T
            if odd:
                sims[~np.isfinite(sims)] = -np.inf
            if to == 0:  # the first columns give the first bar
                if no_self:
                    sims[own[:, None] == vid[None, :wide]] = -np.inf
                if sims.shape[1] > k:
                    bar = np.maximum(bar, np.partition(sims, -k, axis=1)[:, -k] - 2e-6)
            nr, nc = np.nonzero(sims >= bar[:, None])
            nscore = np.round(sims[nr, nc], 6)
            ok = np.isfinite(nscore) if floor is None else nscore >= floor
            if no_self:
                ok &= own[nr] != vid[nc + to]
            if ok.any():
                r, c, score = np.concatenate((r, nr[ok])), np.concatenate((c, nc[ok] + to)), np.concatenate((score, nscore[ok]))
                best = np.lexsort((c, -score, r))
                r, c, score = r[best], c[best], score[best]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                keep = place < k
                r, c, score, place = r[keep], c[keep], score[keep], place[keep]
                full = place == k - 1
                bar[r[full]] = np.maximum(score[full] + 4e-7, least)  # a later column needs a higher rounded score
            to, wide = to + wide, BLOCK
        out.append((own[r], vid[c], score))
    return pd.DataFrame(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*out)))))


def _parts(n: int, block: int) -> int:
    """Parts that ``n`` rows are dealt into: small blocks are multiplied within a task, so they do not repeat the other side's rows.

    From sixteen parts on they grow up to ``WIDE`` rows, as each repeats the other side once.
    """
    return max(1, min(-(-n // max(block, BLOCK)), max(16, -(-n // max(block, WIDE)))))


def knn(queries: DataFrame, vectors: DataFrame, k: int, *, min_score: float | None = None, no_self: bool = False, block: int = BLOCK) -> DataFrame:
    """The k most similar vectors of every query (query_id, embedding) -> id, score, rank.

    Exact.  Queries and vectors are dealt into parts of ``BLOCK`` rows (or ``block``, if that
    is more; ``WIDE`` in large tables) by a hash of their id, and every part of queries meets every part of vectors, up
    to ``block`` queries in one matrix product that keeps k hits per query.  The grid follows the two counts, at every size; ids keep
    their type.  Metadata filters and id lists are filters or semi joins on ``vectors``.
    """
    nq, nv = (_parts(df.count(), block) for df in (queries, vectors))
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"]
    part = lambda id_, n: F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query_id", F.col("embedding").alias("asked"), part("query_id", nq).alias("qp")).withColumn("vp", every(nv))
    v = vectors.select("id", "embedding", part("id", nv).alias("vp")).withColumn("qp", every(nq))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"][:0], "id": right["id"][:0], "score": np.zeros(0)})
        return _best(left["query_id"].to_numpy(), _unit(left["asked"]), right["id"].to_numpy(), _unit(right["embedding"]), k, min_score, no_self, min(block, ROWS))

    hits = q.groupBy("qp", "vp").cogroup(v.groupBy("qp", "vp")).applyInPandas(meet, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return top_k(hits, ["query_id"], [F.desc("score"), F.col("id")], k, "rank")


def chunk_knn(queries: DataFrame, chunks: DataFrame, k: int, *, min_score: float | None = None) -> DataFrame:
    """Best papers by their best chunk; 3k chunks are fetched, two are shown.

    ``chunks``: chunk_id, paper_id, chunk_index, section, text, embedding.
    """
    hits = knn(queries, chunks.select(F.col("chunk_id").alias("id"), "embedding"), 3 * k, min_score=min_score)
    hits = hits.join(chunks.drop("embedding"), hits.id == chunks.chunk_id)
    return top_k(collapse_chunks(hits), ["query_id"], [F.desc("score"), F.col("paper_id")], k, "rank")


def similar_papers(vectors: DataFrame, k: int, *, min_score: float | None = None, text_vectors: DataFrame | None = None, ask: str = "true") -> DataFrame:
    """Neighbours of every vector for which ``ask`` holds, itself excluded.

    ``text_vectors`` (id, embedding), made of title and abstract, stand in for papers
    without a vector of their own: they ask, but are not found.
    """
    asking = vectors.select("id", "embedding")
    if text_vectors is not None:
        have = vectors.select(F.col("id").alias("_have"))
        more = text_vectors.select(F.col("id").alias("id"), F.col("embedding").alias("embedding"))
        asking = asking.unionByName(more.join(have, F.col("id") == F.col("_have"), "left_anti"))
    return knn(asking.filter(ask).withColumnRenamed("id", "query_id"), vectors, k, min_score=min_score, no_self=True)


def prefer_types(hits: DataFrame, contents: DataFrame, prefer: list[str], k: int) -> DataFrame:
    """Hits re-ordered so that preferred paper types come first."""
    types = contents.select(F.col("paper_id").alias("id"), "paper_type")
    out = hits.join(types, "id", "left").withColumn("preferred", F.coalesce(F.col("paper_type").isin(prefer), F.lit(False)))
    return top_k(out, ["query_id"], [F.desc("preferred"), F.desc("score"), F.col("id")], k, "rank")


def suggest_citations(queries: DataFrame, chunks: DataFrame, contents: DataFrame, prefer: list[str], k: int, *,
                      min_score: float = 0.4) -> DataFrame:
    """Papers to cite for a text, found over chunks: three times ``k`` papers are fetched before preferred types move up."""
    hits = chunk_knn(queries, chunks, 3 * k, min_score=min_score).withColumnRenamed("paper_id", "id").drop("rank")
    return prefer_types(hits, contents, prefer, k)
