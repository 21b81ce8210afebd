"""Operator 12: importance resampling towards a target distribution.

Hashed n-grams of all documents and of all target texts are counted per bucket; a bucket's gain is the logarithm of its smoothed share in
the target over that in the documents, a document's weight the mean gain of its n-grams.  Gumbel noise from a hash of the id makes the
highest scores a draw without replacement in proportion to the weights.

Texts are read in Arrow batches: ``ascii_lower``, ``split_pattern_regex`` and ``list_flatten`` give the words, ``dictionary_encode`` numbers them.
Shifted indices of words in a row form n-grams; only distinct ones are hashed, a longer one from the CRC of its beginning.  Buckets and gains are
then taken by index, and summed per document.

What is kept beside the rows is ``buckets`` numbers.  The draw needs no global sort: rows are counted per score and range of ids, running sums over
these counts give every group its first rank, and only within a group are rows put in order.

Defined results: a null, empty or wordless text has no features and weight 0; a null ``doc_id`` is hashed as an empty one and is the last among ties;
rows that share ``doc_id`` and text are equal in score and take successive ranks; an empty target or an empty table of documents is smoothed like
any other; input columns with the names of new ones give way to them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.common import col, others, pieces, schema_with
from quire.session import checkpointed

#: Fixed values of the word rule: everything in ASCII but letters and digits separates words (letters are in lower case by then).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAMS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10000, 10, 20, 2024
#: Ranges of ids that tied scores are cut into, and scores that share a running sum.
RANGES, BAND = 64, 256


def grams(texts: pa.Array, n: int, buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each length 1 .. ``n`` (document, bucket) of all word n-grams in order of the documents; and the number of words of each text."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
    flat = pc.list_flatten(lists)
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(flat), 0)
    flat, doc = flat.filter(real), doc[real.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    words, index = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    crc = np.array([zlib.crc32(w) for w in words], np.int64)
    out, gram = [], index
    for length in range(1, n + 1):
        if length > 1:  # a gram of this length: one of the length before, and the word after it
            whole = doc[length - 1:] == doc[: len(doc) - length + 1]
            pair = gram[: len(doc) - length + 1] * max(1, len(words)) + index[length - 1:]
            kinds, numbers = np.unique(pair[whole], return_inverse=True)
            before, last = np.divmod(kinds, max(1, len(words)))
            crc = np.array([zlib.crc32(b" " + words[w], int(c)) for c, w in zip(crc[before], last)], np.int64)
            gram = np.zeros(len(whole), np.int64)
            gram[whole] = numbers
            out.append((doc[: len(whole)][whole], crc[numbers] % buckets))
        else:
            out.append((doc, crc[index] % buckets))
    return out, np.bincount(doc, minlength=len(texts))


def counts(docs: DataFrame, *, text: str = "text", n: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """Number of n-grams of all texts per bucket: (bucket, count).  A task sums its texts up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches, "text"):
            for _, found in grams(batch.column("text"), n, buckets)[0]:
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "count"])

    return docs.select(col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(docs: DataFrame, target: DataFrame, *, text: str = "text", n: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket, in thousandths rounded down; brings at most 2 * ``buckets`` counts to the driver."""
    both = []
    for rows in (docs, target):
        got = np.zeros(buckets, np.int64)
        for r in counts(rows, text=text, n=n, buckets=buckets).collect():
            got[r["bucket"]] = r["count"]
        both.append(got.astype(float))
    s, t = both
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, *, text: str = "text", n: int = GRAMS, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``n_words``, ``n_features`` and ``weight``, the mean gain of the n-grams rounded down."""
    new = {"n_words": "long", "n_features": "long", "weight": "long"}
    src = docs.select(*others(docs, [*new, "__text"], drop), col(text).cast("string").alias("__text"))
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            found, words = grams(batch.column("__text"), n, buckets)
            features, total = np.zeros((2, batch.num_rows), np.int64)
            for doc, bucket in found:
                ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                sums = np.concatenate(([0], np.cumsum(shared.value.take(bucket))))
                features += np.diff(ends)
                total += np.diff(sums[ends])
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(words.astype(np.int64)), pa.array(features), pa.array(weight)], [*names, *new])

    return src.mapInArrow(run, schema_with(src.drop("__text"), **new))


def draw(weighed: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Add ``score`` and ``rank`` (1, 2, ... from the highest score, ties to the smaller id; null: not drawn) to rows with ``doc_id``, ``n_words`` and ``weight``.

    ``percent`` of the rows of at least ``least_words`` words are drawn.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = weighed.select(*others(weighed, ["score", "rank"])).withColumn("score", (F.col("weight") + noise).cast("long"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    ranges = F.size(F.filter(F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<bigint>"), lambda c: c < F.col("doc_id")))
    rows = rows.withColumns({"__in": F.col("n_words") >= least_words, "__range": F.when(F.col("doc_id").isNull(), RANGES).otherwise(ranges)})
    # first rank of every score and range: running sums over bands of scores, and inside each band
    each = rows.filter("__in").groupBy("score", "__range").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.col("score") / BAND))
    bands = each.groupBy("band").agg(F.sum("n").alias("n"))  # the range of scores bounds these
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = bands.select("band", before(Window.orderBy(F.desc("band"))).alias("start"), F.sum("n").over(Window.partitionBy()).alias("all"))
    first = each.withColumn("own", before(Window.partitionBy("band").orderBy(F.desc("score"), "__range"))).join(bands, "band")
    drawn = F.floor(F.col("all") * percent / 100)
    first = first.filter(F.col("start") + F.col("own") < drawn).select("score", "__range", (F.col("start") + F.col("own")).alias("__start"), drawn.alias("__drawn"))
    nth = F.row_number().over(Window.partitionBy("score", "__range", "__in").orderBy("doc_id"))
    rank = F.when(F.col("__in"), F.col("__start") + nth)
    out = rows.join(first, ["score", "__range"], "left").withColumn("rank", rank)
    return out.withColumn("rank", F.when(F.col("rank") <= F.col("__drawn"), F.col("rank"))).select(*others(weighed, ["score", "rank"]), "score", "rank")


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Features, weight, score and rank of every document."""
    rows = weigh(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), gains(docs, target), drop=("text",))
    return draw(checkpointed(rows)).select("doc_id", "n_features", "weight", "score", "rank")


#: Steps of the CRC-32 of zip files for four bits.
CRC_STEPS = [0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
             0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes in DuckDB's SQL: two steps of four bits for each byte."""
    step = lambda c: f"xor(({c}) >> 4, {CRC_STEPS}[1 + (({c}) & 15)])"
    one = step(step("xor(c, b)"))
    codes = f"list_transform(range(0, CAST(length(hex(encode({text}))) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {one}), 4294967295)"


#: The same in DuckDB's SQL.
RESAMPLED_SQL = rf"""
WITH t AS (SELECT doc_id, 0 AS target, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
w AS (SELECT doc_id, target, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM t),
c AS (SELECT doc_id, target, word, count(*) AS n FROM w GROUP BY ALL),
b AS (SELECT word, {crc32_sql("word")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM c)),
k AS (SELECT bucket, sum(n) FILTER (WHERE target = 0) AS s, sum(n) FILTER (WHERE target = 1) AS t FROM c JOIN b USING (word) GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM k),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM k, a),
d AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM c JOIN b USING (word) JOIN g USING (bucket) WHERE target = 0 GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || left(sha256('{SEED}:' || doc_id), 8) AS BIGINT) AS h FROM documents LEFT JOIN d USING (doc_id)),
x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
o AS (SELECT *, n_features >= {LEAST_WORDS} AS ok, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS nth, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND nth <= {PERCENT} * n // 100 THEN nth END AS rank FROM o"""
