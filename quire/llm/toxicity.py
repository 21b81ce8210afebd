"""Operator 13: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashed words, pairs of neighbours and pairs that leave out one or two words; each counts once,
however long the text, so that one insult in a long text weighs as much as in a short one.  Every coordinate has its own learning rate, and
the L1 term keeps coordinates at exactly zero until their gradients outweigh it: what remains are a few weights, broadcast as
(index, weight) pairs.  The bias starts at the share of toxic rows and is not regularised.

Training reads at most ``sample`` labelled documents (a documented bound, chosen by a hash of the id), in order; with ``shards``
above one that many tasks learn side by side and their weights are averaged.  Every document is scored whole.

Defined results: null, empty and blank texts have no features and get the score of the bias; null labels and labels without a document are
not learned from; a document with several labels counts as toxic if one says so; without any label the score is 0.5 for all; repeated
rows get equal scores; input columns with the names of new ones give way to them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import col, others, pieces, schema_with
from quire.llm.quality import held_out

BITS, SKIPS = 20, 2
DIMS = 1 << BITS
#: Everything in ASCII but letters and digits separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _pair(kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _ODD[0] + b + np.uint64(kind)) * _ODD[1]
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Document and index of every distinct feature, in order of both."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), SEPARATORS)
    flat, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(flat), 0)
    flat, doc = flat.filter(real), doc[real.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    names = np.array([zlib.crc32(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    word = names[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    keys = [doc * DIMS + _pair(0, word, np.zeros_like(word))]
    for gap in range(1, SKIPS + 2):  # neighbours, then pairs with words left out
        a = np.flatnonzero(doc[gap:] == doc[: len(doc) - gap])
        keys.append(doc[a] * DIMS + _pair(gap, word[a], word[a + gap]))
    return np.divmod(np.unique(np.concatenate(keys)), DIMS)


def ftrl(rows: list[tuple[int, np.ndarray]], *, start: float, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[dict[int, float], float]:
    """Nonzero weights and bias after FTRL-proximal steps over the rows (label, indices), ``epochs`` times; ``start`` is the first bias."""
    z, n = np.zeros(DIMS), np.zeros(DIMS)
    bias, seen = start, 0.0
    for _ in range(epochs):
        for y, at in rows:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            g = 1 / (1 + math.exp(-min(35.0, max(-35.0, bias + w.sum())))) - y
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - root) / alpha * w
            n[at] = grown
            seen += g * g
            bias -= alpha / (beta + math.sqrt(seen)) * g
    at = np.flatnonzero(np.abs(z) > l1)
    w = (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2)
    return dict(zip(at.tolist(), w.tolist())), bias


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "toxic", sample: int = 16000, shards: int = 1,
          epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1) -> DataFrame:
    """Averaged weights (index, weight), the bias under index -1, learned from at most ``sample`` labelled documents."""
    chosen = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(shards)).cast("int")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), col(text).cast("string").alias("__text")).join(F.broadcast(chosen), "doc_id")  # ``sample`` rows at most

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            doc, index = features(batch.column("__text"))
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(index.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "y", "shard")), lists], ["doc_id", "y", "shard", "index"])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(order=[zlib.crc32(str(d).encode(), 3) for d in part.doc_id]).sort_values(["order", "doc_id"])
        share = min(0.95, max(0.05, float(part.y.mean())))
        w, bias = ftrl([(y, np.asarray(i, np.int64)) for y, i in zip(part.y, part["index"])], start=math.log(share / (1 - share)), epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2)
        return pd.DataFrame({"index": [-1, *w], "weight": [bias, *w.values()]}).astype({"index": "int32"})

    vectors = rows.mapInArrow(describe, "doc_id long, y int, shard int, index array<int>")
    parts = vectors.groupBy("shard").applyInPandas(fit, "index int, weight double")
    return parts.groupBy("index").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def model_of(weights: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices, weights and bias on the driver: at most DIMS + 1 numbers, in practice the few that L1 left."""
    got = weights.toPandas().sort_values("index")
    bias = got[got["index"] == -1]
    shards = max([1, *bias["n"]])  # every shard with rows gives one bias
    got = got[got["index"] >= 0]
    return got["index"].to_numpy(np.int64), got["weight"].to_numpy(float) / shards, float(bias["weight"].sum() / shards)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``score`` (0 to 1): the logistic of the bias and the weights of the document's features."""
    src = docs.select(*others(docs, ["score", "__text"], drop), col(text).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        table = np.zeros(DIMS)
        table[at] = w
        for batch in pieces(batches, "__text", 2 << 20):
            doc, index = features(batch.column("__text"))
            total = np.bincount(doc, table[index], minlength=batch.num_rows)
            out = 1 / (1 + np.exp(-np.clip(bias + total, -35, 35)))
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out)], [*names, "score"])

    return src.mapInArrow(run, schema_with(src.drop("__text"), score="double"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Held-out mark, score and decision of every document."""
    model = model_of(train(docs, labels.filter(~held_out())))
    return (score(docs.select("doc_id", "text"), model, drop=("text",))
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")))
