"""Operator 8: quality classifier, logistic regression on hashed word n-grams trained by follow-the-regularised-leader.

A word counts as its letters and digits in lower case and as its shape (marks around it, and the case of what is between).
Hashed features are n-grams of both, and repeats of the word before.  A document's vector is its features' shares of its
words, so a score is a mean of weights: a sparse dot product, one pass over the words.  Training reads at most ``sample`` labelled
documents (a documented bound, chosen by a hash of the id), in ``shards`` tasks whose weights are averaged; every document is scored.

Defined results: null, empty and blank texts have no features and get the score of the bias alone; null labels are not learned
from; a document with several labels counts as good if one is; without labels of both kinds the score is the same for all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import col, give_back, others, pieces, schema_with

DIMS = 1 << 18
#: Bytes of text whose features are made at once.
PIECE = 1 << 20
_EDGES = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def word_codes(word: str) -> tuple[int, int]:
    """Codes of a word's letters and of its shape."""
    before, core, after = _EDGES.match(word).groups()
    kind = "" if not core else "0" if core.isdigit() else "AA" if len(core) > 1 and core.isupper() else "a" if core.islower() else "Aa" if core[0].isupper() else "x"
    return zlib.crc32(core.lower().encode("utf-8", "replace")), zlib.crc32(f"{before}\0{kind}\0{after}".encode("utf-8", "replace"), 1)


def _hashed(kind: int, *codes: np.ndarray) -> np.ndarray:
    h = np.full(len(codes[0]), kind * 0x51ED2701, np.uint64)
    for c in codes:
        h = (h ^ c) * _MIX[0]
        h ^= h >> np.uint64(29)
        h *= _MIX[1]
        h ^= h >> np.uint64(32)
    return (h & np.uint64(DIMS - 1)).astype(np.int64)


def features(texts: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Feature families as (document of each feature, feature), and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    flat, doc = flat.filter(pa.array(real)), doc[real]
    words = flat.dictionary_encode()
    codes = np.array([word_codes(w) for w in words.dictionary.to_pylist()], np.uint64).reshape(-1, 2)
    core, shape = codes[words.indices.to_numpy()].T if len(flat) else (np.zeros(0, np.uint64),) * 2
    out = [(doc, _hashed(1, shape)), (doc, _hashed(2, core))]
    for n in (2, 3):
        same = doc[n - 1:] == doc[: len(doc) - n + 1]
        at = np.flatnonzero(same)
        out.append((doc[at], _hashed(2 + n, *(shape[at + i] for i in range(n)))))
        if n == 2:
            out.append((doc[at], _hashed(6, core[at], core[at + 1])))
            again = at[(core[at] == core[at + 1])]
            out.append((doc[again], _hashed(7, np.zeros(len(again), np.uint64))))
    return out, np.bincount(doc, minlength=len(sizes))


def _vectors(docs: DataFrame) -> DataFrame:
    """Sparse vectors of (doc_id, y, shard, __text): indices ascending, shares as values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text", PIECE):
            families, n = features(batch.column("__text"))
            both = np.concatenate([d * DIMS + f for d, f in families])
            key, count = np.unique(both, return_counts=True)
            doc = key // DIMS
            share = count / np.maximum(n[doc], 1)
            ends = np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)
            index = pa.ListArray.from_arrays(ends, pa.array((key % DIMS).astype(np.int32)))
            value = pa.ListArray.from_arrays(ends, pa.array(share.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "y", "shard")] + [index, value], ["doc_id", "y", "shard", "index", "value"])

    return docs.mapInArrow(run, "doc_id long, y int, shard int, index array<int>, value array<float>")


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], *, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Weights and bias after follow-the-regularised-leader steps over the rows (label, indices, values), ``epochs`` times.

    Rows are read as they are; the bias is added and numbers are widened for one row at a time.
    """
    z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for y, i, v in rows:
            i, v = np.append(i, DIMS), np.append(v, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / alpha * w
            n[i] = grown
    w = weights(np.arange(DIMS + 1))
    return w[:DIMS], float(w[DIMS])


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "quality", sample: int = 8000, shards: int = 4,
          epochs: int = 4, alpha: float = 2.0, beta: float = 0.01, l1: float = 1e-4, l2: float = 1e-4) -> DataFrame:
    """Weights (index, weight; the bias has index DIMS) learned from at most ``sample`` labelled documents."""
    chosen = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("shard", F.pmod(F.hash("doc_id"), F.lit(shards)).cast("int")))
    rows = docs.select(F.col("doc_id").cast("long"), col(text).cast("string").alias("__text")).join(F.broadcast(chosen), "doc_id")
    vectors = _vectors(rows.select("doc_id", "y", "shard", "__text"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(order=[zlib.crc32(str(d).encode(), 7) for d in part.doc_id]).sort_values(["order", "doc_id"])
        w, bias = ftrl(list(zip(part.y, part["index"], part["value"])), epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2)
        at = np.flatnonzero(w)
        del part
        give_back()
        return pd.DataFrame({"index": np.append(at, DIMS).astype("int32"), "weight": np.append(w[at], bias)})

    parts = vectors.groupBy("shard").applyInPandas(fit, "index int, weight double")
    # every shard gives the bias once, so its count is the number of shards with rows
    return parts.groupBy("index").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))


def model_of(weights: DataFrame) -> tuple[np.ndarray, float]:
    """Averaged weights and bias on the driver: at most DIMS + 1 numbers."""
    got = weights.toPandas()
    w = np.zeros(DIMS + 1)
    shards = max([1, *got.loc[got["index"] == DIMS, "n"]])
    w[got["index"].to_numpy(np.int64)] = got["total"].to_numpy(float) / shards
    return w[:DIMS].astype(np.float32), float(w[DIMS])


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``score`` (0 to 1) to each row: the logistic of bias and sparse dot product."""
    src = docs.select(*others(docs, ["score", "__text"], drop), col(text).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for batch in pieces(batches, "__text", PIECE):
            families, n = features(batch.column("__text"))
            total = sum(np.bincount(d, w[f], minlength=len(n)) for d, f in families)
            out = 1 / (1 + np.exp(-np.clip(bias + total / np.maximum(n, 1), -35, 35)))
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out)], [*names, "score"])

    return src.mapInArrow(run, schema_with(src.drop("__text"), score="double"))


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Held-out mark, score and decision of every document."""
    model = model_of(train(docs, labels.filter(~held_out())))
    return (score(docs.select("doc_id", "text"), model, drop=("text",))
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
