"""BM25 with bounds per block of documents: the best k of every query without scoring every posting.

A blocked index stores, for every term and block of documents, the highest weighted frequency and the shortest document length, which
bound the term's contribution for any parameters.  A query's bound for a block is the sum over its terms.

1. Bounds are summed from the small block table; no posting is read.
2. The blocks with the highest bounds are scored.  The k-th best score there is a threshold that the result cannot fall below.
3. Only blocks whose bound reaches the threshold are scored besides.

The result equals that of ``retrieval.bm25``.  Blocks hold documents of like length, so that a block's shortest length says something about
all of it; postings are sorted by bucket, term and block, so what a round reads lies together.  All rounds join on term and block: a
common term is spread over its blocks and no key is hot.

Defined results: queries without a known term have no rows; scores are rounded to six digits before they are ranked, ties go to the
smaller id; a query with fewer than k hits in the first round has no threshold and reads all its blocks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.operators.retrieval import B, K1, MIN_IDF, _in_years
from quire.operators.textindex import TextIndex, bucket_of, load_index, postings_schema, query_terms
from quire.session import checkpointed, shared_folder, top_k

#: Documents in a block, about, at least; blocks an index has, about, at most; blocks scored in the first round.
BLOCK_DOCS, BLOCKS, FIRST = 4, 2500, 16
#: Bounds and scores are sums of rounded numbers.
SLACK = 2e-6


@dataclass
class BlockedIndex(TextIndex):
    """A stored index whose postings carry ``block``; ``blocks``: bucket, term, block, f (highest), dl (lowest), n (postings)."""

    blocks: DataFrame | None = None


def _length_class(dl: Column) -> Column:
    """Four classes to a doubling of the length: at most 125 of them."""
    return F.floor(4 * F.log2(dl.cast("double") + 1)).cast("int")


def save_blocked(index: TextIndex, path: str, *, buckets: int = 64, block_docs: int | None = None) -> None:
    """Persist the index with its block table.

    Without ``block_docs`` blocks grow with the documents, so that a query has about ``BLOCKS`` bounds at every size.
    """
    classes = index.docs.groupBy(_length_class(F.col("dl")).alias("c")).agg(F.count("*").alias("n")).collect()  # one row a class
    size = block_docs or max(BLOCK_DOCS, -(-sum(r["n"] for r in classes) // BLOCKS))
    parts = F.element_at(F.create_map(*[F.lit(v) for r in classes for v in (r["c"], -(-r["n"] // size))]), F.col("class")) if classes else F.lit(1)
    rows = index.postings.withColumn("bucket", bucket_of(buckets)).withColumn("class", _length_class(F.col("dl")))
    rows = rows.withColumn("block", F.shiftleft(F.col("class").cast("long"), 40) + F.pmod(F.xxhash64("doc_id"), parts.cast("long"))).drop("class")
    rows = rows.repartition(buckets, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
    rows.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    spark = index.postings.sparkSession
    written = spark.read.schema(postings_schema(index.docs, "block long, ")).parquet(f"{path}/postings")
    blocks = written.groupBy("bucket", "term", "block").agg(F.max("f").alias("f"), F.min("dl").alias("dl"), F.count("*").alias("n"))
    blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    spark.read.schema("term string, n long, bucket int").parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")


def load_blocked(spark: SparkSession, path: str, stemmed: bool = False, buckets: int = 64) -> BlockedIndex:
    """A saved index; ``buckets`` as it was saved."""
    i = load_index(spark, path, stemmed, buckets)
    postings = spark.read.schema(postings_schema(i.docs, "block long, ")).parquet(f"{path}/postings")
    blocks = spark.read.schema("term string, block long, f double, dl int, n long, bucket int").parquet(f"{path}/blocks")
    return BlockedIndex(postings, i.docs, i.terms, i.stemmed, i.buckets, blocks)


def stored_blocked(index: TextIndex, block_docs: int | None = None) -> BlockedIndex:
    """The index written once to the shared folder, with bounds, and read back."""
    spark = index.postings.sparkSession
    path = f"{shared_folder(spark)}/blocked-{uuid.uuid4().hex}"
    save_blocked(index, path, buckets=8, block_docs=block_docs)
    return load_blocked(spark, path, index.stemmed, 8)


def _rounds(queries: DataFrame, index: BlockedIndex, k: int, inside: DataFrame | None, k1: float, b: float, first: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores (query_id, doc_id, score) of both rounds, the bounds (query_id, block, bound, n), and which of these were read."""
    n, avgdl = index.docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("a")).first()
    terms = query_terms(queries, index).select("query_id", "term").distinct().join(index.terms, "term")
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(MIN_IDF))
    terms = checkpointed(index.keyed(terms.select("query_id", "term", idf.alias("idf"))))
    gain = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    bounds = index.blocks.join(terms, ["bucket", "term"]).groupBy("query_id", "block").agg(F.sum(gain).alias("bound"), F.sum("n").alias("n"))
    bounds = checkpointed(bounds)
    rows = index.postings.select("bucket", "term", "block", "doc_id", "dl", "f")
    if inside is not None:
        rows = rows.join(inside, "doc_id", "left_semi")

    def scored(wanted: DataFrame) -> DataFrame:
        want = index.blocks.select("bucket", "term", "block").join(terms, ["bucket", "term"]).join(wanted.select("query_id", "block"), ["query_id", "block"])
        hit = rows.join(want, ["bucket", "term", "block"])
        return hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(gain), 6).alias("score"))

    best = top_k(bounds, ["query_id"], [F.desc("bound"), F.col("block")], first)
    one = checkpointed(scored(best))
    floor = top_k(one, ["query_id"], [F.desc("score"), F.col("doc_id")], k, "rank").filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    left = bounds.join(best.select("query_id", "block"), ["query_id", "block"], "left_anti").join(floor, "query_id", "left")
    left = left.filter(F.col("floor").isNull() | (F.col("bound") * (1 + 1e-9) + SLACK >= F.col("floor"))).drop("floor")
    read = checkpointed(best.select("query_id", "block", "n").unionByName(left.select("query_id", "block", "n")))
    two = scored(left)
    return one.unionByName(two), bounds, read


def bm25(queries: DataFrame, index: BlockedIndex, *, docs: DataFrame | None = None, year_min: int | None = None, year_max: int | None = None,
         k: int = 10, k1: float = K1, b: float = B, first: int = FIRST) -> DataFrame:
    """Best documents of every query; the same rows as ``retrieval.bm25`` from the postings of the blocks that can matter."""
    inside = _in_years(docs, year_min, year_max) if docs is not None else None
    both, _, _ = _rounds(queries, index, k, inside, k1, b, first)
    return top_k(both, ["query_id"], [F.desc("score"), F.col("doc_id")], k, "rank").select("query_id", "doc_id", "score", "rank")


def postings_read(queries: DataFrame, index: BlockedIndex, *, k: int = 10, k1: float = K1, b: float = B, first: int = FIRST) -> DataFrame:
    """Per query the postings of its terms, and how many of them lie in blocks that are scored."""
    _, bounds, read = _rounds(queries, index, k, None, k1, b, first)
    whole = bounds.groupBy("query_id").agg(F.sum("n").alias("postings"), F.count("*").alias("blocks"))
    part = read.groupBy("query_id").agg(F.sum("n").alias("postings_read"), F.count("*").alias("blocks_read"))
    return whole.join(part, "query_id")
