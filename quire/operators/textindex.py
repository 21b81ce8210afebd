"""Inverted text index with weighted fields."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions.stemming import fold, folded, porter, stem
from quire.functions.text import tokens
from quire.session import shared_folder, spread

#: Default field weights.
WEIGHTS = {"title": 10.0, "abstract": 5.0}
#: Tokens whose postings are made at once.
PIECE = 1 << 17
#: Tokens whose postings are sorted and written by one task.
WRITTEN = 1 << 21


@dataclass
class TextIndex:
    """``postings``: term, doc_id, dl, f (weighted frequency), tf, hits (field, pos).
    ``docs``: doc_id, dl for every indexed document.  ``terms``: term, df.
    ``stemmed``: query terms go through the same folding and stemming.
    ``buckets``: a stored index is partitioned by this many hash buckets of the term."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    stemmed: bool = False
    buckets: int | None = None

    def size(self) -> Column:
        return self.docs.agg(F.count("*").alias("n")).scalar()

    def mean_length(self) -> Column:
        return self.docs.agg(F.avg("dl").alias("a")).scalar()

    @property
    def on(self) -> list[str]:
        """Join columns of the postings; the bucket lets a scan skip the partitions no wanted term is in."""
        return ["term"] if self.buckets is None else ["bucket", "term"]

    def keyed(self, terms: DataFrame) -> DataFrame:
        """A table of terms with the join columns of the postings."""
        return terms if self.buckets is None else terms.withColumn("bucket", bucket_of(self.buckets))


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def tokenised(docs: DataFrame, weights: dict[str, float] = WEIGHTS, key: str = "id") -> DataFrame:
    """Tokens of each document and field: doc_id, field, weight, tokens, dl (tokens over all fields)."""
    fields = [F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), tokens(f).alias("tokens")) for f, w in weights.items()]
    rows = spread(docs.select(key, *weights), key).select(F.col(key).alias("doc_id"), F.array(*fields).alias("fields"))
    rows = rows.withColumn("dl", F.aggregate("fields", F.lit(0), lambda n, f: n + F.size(f["tokens"])))
    return rows.select("doc_id", "dl", F.inline("fields"))


def normalise_terms(rows: DataFrame, column: str = "term") -> DataFrame:
    """Fold diacritics and stem."""
    return rows.withColumn(column, stem(fold(column)))


def _count_terms(batch: pa.RecordBatch, weights: dict[str, float], stemmed: bool) -> pa.RecordBatch:
    """Postings of a batch of documents: each row's tokens sorted by term, one posting per term."""
    terms, row, pos, field = [], [], [], []
    for k in range(len(weights)):
        lists = batch.column(f"tokens_{k}")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        terms.append(lists.flatten())
        row.append(np.repeat(np.arange(len(sizes)), sizes))
        pos.append(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        field.append(np.full(sizes.sum(), k))
    row, pos, field = map(np.concatenate, (row, pos, field))
    coded = pa.chunked_array(terms, pa.string()).combine_chunks().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if stemmed:  # once per distinct word of the batch
        again = pa.array([porter(folded(w)) for w in words.to_pylist()], pa.string()).dictionary_encode()
        words, code = again.dictionary, again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]
    order = np.lexsort((pos, field, code, row))
    row, pos, field, code = (x[order] for x in (row, pos, field, code))
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else np.zeros(0, np.int64)
    ends = np.append(first, len(row)).astype(np.int32)
    weight = np.array(list(weights.values()), float)[field]
    names = pa.array(list(weights), pa.string()).take(pa.array(field))
    hits = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([names, pa.array(pos.astype(np.int32))], ["field", "pos"]))
    total = np.add.reduceat(weight, first) if len(first) else np.zeros(0)
    owner = pa.array(row[first])
    return pa.RecordBatch.from_arrays([words.take(pa.array(code[first])), batch.column("doc_id").take(owner), batch.column("dl").take(owner), pa.array(total),
                                       pa.array(np.diff(ends).astype(np.int64)), hits], ["term", "doc_id", "dl", "f", "tf", "hits"])


def _pieces(batch: pa.RecordBatch, fields: int, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` tokens each; a longer document is a part of its own."""
    sizes = sum(pc.fill_null(pc.list_value_length(batch.column(f"tokens_{k}")), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(fields))
    at, n = 0, 0
    for i, more in enumerate(sizes.tolist()):
        if n and n + more > limit:
            yield batch.slice(at, i - at)
            at, n = i, 0
        n += more
    if at < batch.num_rows:
        yield batch.slice(at)


def build_index(docs: DataFrame, weights: dict[str, float] = WEIGHTS, *, key: str = "id", stemmed: bool = False,
                only: DataFrame | None = None) -> TextIndex:
    """R01.  ``only`` (a ``term`` table) restricts the postings to the terms a query batch needs.

    A document is one row, so its terms are counted where it is read and no token is
    shuffled; only the document frequencies are grouped, with partial sums.
    """
    rows = spread(docs.select(key, *weights), key)
    rows = rows.select(F.col(key).alias("doc_id"), *[tokens(f).alias(f"tokens_{k}") for k, f in enumerate(weights)])
    sizes = [F.size(f"tokens_{k}") for k in range(len(weights))]
    rows = rows.withColumn("dl", reduce(lambda a, b: a + b, sizes))
    kind = dict(rows.dtypes)["doc_id"]
    postings = rows.mapInArrow(lambda batches: (_count_terms(p, weights, stemmed) for b in batches for p in _pieces(b, len(weights))),
                               f"term string, doc_id {kind}, dl int, f double, tf bigint, hits array<struct<field:string,pos:int>>")
    if only is not None:
        postings = postings.join(only.select("term").distinct(), "term", "left_semi")
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    return TextIndex(postings, rows.select("doc_id", "dl"), terms, stemmed)


def query_terms(queries: DataFrame, index: TextIndex | None = None) -> DataFrame:
    """query_id, offset, term of every query token, normalised as the index was."""
    rows = queries.select("query_id", F.posexplode(tokens("query")).alias("offset", "term"))
    return normalise_terms(rows) if index is not None and index.stemmed else rows


def save_index(index: TextIndex, path: str, buckets: int = 64) -> None:
    """Persist the index; postings are laid out by a hash bucket of the term and sorted inside."""
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    length = index.postings.sparkSession.read.schema("dl int").parquet(f"{path}/docs").agg(F.sum("dl")).first()[0]
    write_postings(index.postings.withColumn("bucket", bucket_of(buckets)), f"{path}/postings", buckets, length or 0)
    written = index.postings.sparkSession.read.schema(postings_schema(index.docs)).parquet(f"{path}/postings")
    written.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")


def write_postings(postings: DataFrame, path: str, buckets: int, length: int) -> None:
    """Write postings of documents of ``length`` tokens in all: parts of a bucket by document, so that a task's share does not grow with them."""
    parts = max(1, math.ceil(length / WRITTEN / buckets))
    place = F.col("bucket") * parts + F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    rows = postings.repartitionById(buckets * parts, place)
    rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def postings_schema(docs: DataFrame, more: str = "") -> str:
    """Columns of stored postings: an index without postings leaves no file to read them from."""
    kind = dict(docs.dtypes)["doc_id"]
    return f"term string, doc_id {kind}, dl int, f double, tf bigint, hits array<struct<field:string,pos:int>>, {more}bucket int"


def load_index(spark: SparkSession, path: str, stemmed: bool = False, buckets: int = 64) -> TextIndex:
    """A saved index; ``buckets`` as it was saved."""
    read = spark.read.parquet
    docs = read(f"{path}/docs")
    return TextIndex(spark.read.schema(postings_schema(docs)).parquet(f"{path}/postings"), docs, read(f"{path}/terms"), stemmed, buckets)


def stored(index: TextIndex) -> TextIndex:
    """The index written once to the shared folder and read back, for several uses in a session."""
    spark = index.postings.sparkSession
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    save_index(index, path, buckets=8)
    return load_index(spark, path, index.stemmed, 8)


def index_status(docs: DataFrame, index_docs: DataFrame) -> DataFrame:
    """Indexed against total documents, and whether a rebuild is needed."""
    ids = docs.select(F.col("id").alias("doc_id"))
    both = ids.withColumn("_d", F.lit(1)).join(index_docs.select("doc_id").distinct().withColumn("_i", F.lit(1)), "doc_id", "full_outer")
    out = both.agg(F.count("_i").alias("indexed"), F.count("_d").alias("total"),
                   F.count_if(F.col("_i").isNull()).alias("missing"), F.count_if(F.col("_d").isNull()).alias("stale"))
    return out.withColumn("needs_rebuild", (F.col("missing") > 0) | (F.col("stale") > 0))


def missing_docs(docs: DataFrame, index_docs: DataFrame) -> DataFrame:
    """Documents the index lacks."""
    return docs.select(F.col("id").alias("doc_id")).join(index_docs, "doc_id", "left_anti")
