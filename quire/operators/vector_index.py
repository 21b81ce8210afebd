"""Approximate nearest vectors: a coarse quantiser, cells as a partition column, probing with exact re-scoring.

The centres of the cells are fitted on a sample of bounded size; every vector is then assigned to its nearest centre.  A query reads
the cells whose centres are nearest to it and scores all their vectors exactly, so scores equal those of the exact plan and only
neighbours in cells that are not read can be missing; reading all cells gives the exact result.  ``vectors.knn`` stays the exact plan; neither
is chosen by size.

A cell may hold any share of the vectors: it is dealt into parts of eight times ``block`` rows, and so are the queries that read it, so a task
meets about that many of either.  Centres are ``cells`` times the dimension in number and are the only thing that travels whole.

Defined results: a vector that is null, of another dimension or not finite is in no cell and is never found, and such a query finds nothing;
a zero vector has cosine 0 to all; vectors of equal id are separate rows; an empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quire.operators.vectors import BLOCK, WIDE, _best, _unit
from quire.session import shared_folder, top_k

#: Default number of cells and of rows that they are fitted on.
CELLS, SAMPLE = 64, 1 << 15


@dataclass(frozen=True)
class VectorIndex:
    """``vectors``: id, embedding, cell and any other columns.  ``centres``: one unit row per cell."""

    vectors: DataFrame
    centres: np.ndarray


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the usable vectors of an Arrow list column, and which rows those are."""
    lists = column.to_pylist()
    ok = np.array([x is not None and len(x) == dim and all(v is not None and np.isfinite(v) for v in x) for x in lists], bool)
    return _unit([x for x, good in zip(lists, ok) if good]) if ok.any() else np.zeros((0, dim)), ok


def fit_centres(vectors: DataFrame, cells: int = CELLS, *, sample: int = SAMPLE, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centres by spherical k-means on the ``sample`` vectors of the smallest hash of their id.

    The dimension is that of most sampled vectors.  Centres that no vector is nearest to are dropped, so
    fewer than ``cells`` may come out; none for an empty table.
    """
    chosen = vectors.filter("embedding IS NOT NULL").select(F.xxhash64(F.col("id").cast("string"), F.lit(seed)).alias("h"), "embedding").orderBy("h").limit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("h")["embedding"].tolist()  # ``sample`` rows at most
        if not rows:
            return
        lengths = [len(x) for x in rows]
        dim = max(set(lengths), key=lengths.count)
        x = np.array([v for v in rows if len(v) == dim], float)
        x = _unit(x[np.isfinite(x).all(axis=1)])
        x = x[np.abs(x).sum(axis=1) > 0]
        if not len(x):
            return
        r = np.random.default_rng(seed)
        centres = x[r.choice(len(x), 1)]
        far = 1 - x @ centres[0]
        while len(centres) < min(cells, len(x)) and far.max() > 1e-9:  # each next start is drawn by its distance from those before
            centres = np.vstack((centres, x[r.choice(len(x), p=np.maximum(far, 0) / np.maximum(far, 0).sum())]))
            far = np.minimum(far, 1 - x @ centres[-1])
        for _ in range(rounds):
            near = (x @ centres.T).argmax(axis=1)
            used = np.unique(near)
            centres = _unit([x[near == c].sum(axis=0) for c in used])
        yield pd.DataFrame({"centre": list(centres)})

    rows = chosen.coalesce(1).mapInPandas(run, "centre array<double>").collect()
    return np.array([r["centre"] for r in rows], float) if rows else np.zeros((0, 0))


def _celled(rows: DataFrame, centres: np.ndarray, column: str, probes: int) -> DataFrame:
    """Rows with ``cell``: one row for each of the ``probes`` nearest centres."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    out = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x, ok = _matrix(batch.column(column), c.shape[1])
            if not len(c) or not len(x):
                continue
            sims = np.round(x @ c.T, 9)
            near = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.flatnonzero(ok), near.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(near.ravel().astype(np.int32))], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, out)


def build(vectors: DataFrame, cells: int = CELLS, **how) -> VectorIndex:
    """Index of a table with id and embedding; every usable vector gets its cell."""
    centres = fit_centres(vectors, cells, **how)
    return VectorIndex(_celled(vectors, centres, "embedding", 1), centres)


def extend(index: VectorIndex, more: DataFrame) -> VectorIndex:
    """The index with further vectors in its cells; the centres stay."""
    return replace(index, vectors=index.vectors.unionByName(_celled(more, index.centres, "embedding", 1)))


def save(index: VectorIndex, path: str, mode: str = "overwrite") -> None:
    """Vectors partitioned by cell, and the centres.  ``mode`` "append" adds the index's vectors to those at ``path``."""
    spark = index.vectors.sparkSession
    index.vectors.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(8))).write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")
    rows = [(k, [float(v) for v in c]) for k, c in enumerate(index.centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def load(spark: SparkSession, path: str) -> VectorIndex:
    rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["cell"])
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), np.array([r["centre"] for r in rows], float) if rows else np.zeros((0, 0)))


def stored(index: VectorIndex) -> VectorIndex:
    """The index written once to the shared folder and read back."""
    import uuid

    path = f"{shared_folder(index.vectors.sparkSession)}/vectors-{uuid.uuid4().hex}"
    save(index, path)
    return load(index.vectors.sparkSession, path) if len(index.centres) else index


def probe(queries: DataFrame, index: VectorIndex, k: int, *, probes: int = 40, min_score: float | None = None, no_self: bool = False, block: int = BLOCK) -> DataFrame:
    """The k most similar vectors among the ``probes`` nearest cells of every query (query_id, embedding): id, score, rank.

    Metadata filters are filters on the index's ``vectors``: they act before the search.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(index.vectors.dtypes)["id"]
    asked = _celled(queries.select("query_id", F.col("embedding").alias("asked")), index.centres, "asked", probes)
    # rows per cell, at most one row a cell
    parts = lambda rows, name: rows.groupBy("cell").agg(F.ceil(F.count("*") / (block * WIDE // BLOCK)).cast("int").alias(name))
    many = F.broadcast(parts(index.vectors, "nv").join(parts(asked, "nq"), "cell"))
    part = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asked.join(many, "cell").select("query_id", "asked", "cell", part("query_id", "nq").alias("qp"), every("nv").alias("vp"))
    v = index.vectors.select("id", "embedding", "cell").join(many, "cell").select("id", "embedding", "cell", part("id", "nv").alias("vp"), every("nq").alias("qp"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"][:0], "id": right["id"][:0], "score": np.zeros(0)})
        return _best(left["query_id"].to_numpy(), _unit(left["asked"]), right["id"].to_numpy(), _unit(right["embedding"]), k, min_score, no_self)

    on = ["cell", "qp", "vp"]
    hits = q.groupBy(*on).cogroup(v.groupBy(*on)).applyInPandas(meet, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return top_k(hits, ["query_id"], [F.desc("score"), F.col("id")], k, "rank")


def chunk_probe(queries: DataFrame, chunks: DataFrame, index: VectorIndex, k: int, *, probes: int = 40, min_score: float | None = None) -> DataFrame:
    """R08 over an index of the chunks (id: chunk_id): best papers by their best chunk; 3k chunks are fetched, two are shown."""
    from quire.operators.ranking import collapse_chunks

    hits = probe(queries, index, 3 * k, probes=probes, min_score=min_score)
    hits = hits.join(chunks.drop("embedding"), hits.id == chunks.chunk_id)
    return top_k(collapse_chunks(hits), ["query_id"], [F.desc("score"), F.col("paper_id")], k, "rank")


def neighbours(index: VectorIndex, k: int, *, probes: int = 40, min_score: float | None = None, ask: str = "true") -> DataFrame:
    """R09 over an index: neighbours of every vector for which ``ask`` holds, itself excluded, read from the nearest cells in place of all vectors."""
    return probe(index.vectors.filter(ask).select(F.col("id").alias("query_id"), "embedding"), index, k, probes=probes, min_score=min_score, no_self=True)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query of ``exact``: hits, how many of them ``found`` has, and their share."""
    got = found.select("query_id", "id", F.lit(True).alias("hit"))
    both = exact.select("query_id", "id").join(got, ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("hits"), F.count("hit").alias("found")).withColumn("recall", F.round(F.col("found") / F.col("hits"), 6))
