"""Operator 5: document fingerprints by winnowing, in DataFrame functions only.

Every run of ``k`` words has a hash; in every ``window`` runs the smallest hash is kept, the rightmost of equal ones, with its
position.  Two texts that share ``window + k - 1`` consecutive words share a kept hash, wherever the words stand.  A hash (40 bits)
and the negated position (24 bits) are packed into one long, so the minimum of a window is the minimum of primitives and ties
go to the right; kept positions come out in order and once each.

Defined results: a text of fewer words than ``k`` has one run, of all its words; a null, empty or blank text has no fingerprint
(an empty string); two empty fingerprints have likeness 1.  Positions are kept modulo 2^24.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm.common import col, others, words_of

K, WINDOW = 5, 8
_LOW = (1 << 24) - 1


def _runs(df: DataFrame, words: str, out: str, k: int) -> DataFrame:
    """Packed hash and position of every run of ``k`` words."""
    w, n = col(words), F.size(words)
    pack = lambda h, i: h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.lit(_LOW) - i.cast("long").bitwiseAND(F.lit(_LOW)))
    full = F.transform(F.sequence(F.lit(0), n - k), lambda i: pack(F.xxhash64(*(F.get(w, i + j) for j in range(k))), i))
    short = F.array(pack(F.xxhash64(F.array_join(w, " ")), F.lit(0)))
    return df.withColumn(out, F.when(n >= k, full).when(n > 0, short).otherwise(F.array().cast("array<bigint>")))


def winnow(df: DataFrame, text: Column, out: str = "marks", *, k: int = K, window: int = WINDOW) -> DataFrame:
    """Add ``out``: the kept runs of a text as packed longs, in order."""
    df = _runs(df.withColumn("__w", words_of(text)), "__w", "__r", k).drop("__w")
    r, n = F.col("__r"), F.size("__r")
    least = F.transform(F.sequence(F.lit(1), n - window + 1), lambda j: F.array_min(F.slice(r, j, window)))
    return df.withColumn(out, F.when(n >= window, F.array_distinct(least)).when(n > 0, F.array(F.array_min(r))).otherwise(r)).drop("__r")


def hashes(marks: Column) -> Column:
    """Distinct hashes of kept runs."""
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, 24)))


def shown(marks: Column) -> Column:
    """``hash@position`` of each kept run, hash in hexadecimal."""
    one = lambda m: F.concat(F.lpad(F.lower(F.hex(F.shiftrightunsigned(m, 24))), 10, "0"), F.lit("@"), (F.lit(_LOW) - m.bitwiseAND(F.lit(_LOW))).cast("string"))
    return F.array_join(F.transform(marks, one), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two sets of hashes: intersection over union."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame, *, text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Add ``fingerprint`` to each row."""
    src = docs.select(*others(docs, ["fingerprint", "__r", "__w", "__m"]))
    return winnow(src, col(text), "__m", k=k, window=window).withColumn("fingerprint", shown(F.col("__m"))).drop("__m")


def next_ids(docs: DataFrame, splits: int = 256) -> DataFrame:
    """``doc_id`` and ``next_id``, the next smaller id (after the smallest, the largest), with ``need``, a third of the longest text of ``doc_id``.

    Ids are cut at approximate quantiles (``splits`` numbers on the driver), so no task orders them all; a table of one row per
    cut carries the order across cuts.  The cuts decide only where work is done, not the result.
    """
    ids = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.floor(F.length(F.coalesce("text", F.lit(""))) / 3)).alias("need"))
    cuts = docs.select(F.percentile_approx("doc_id", [i / splits for i in range(1, splits)], 10 * splits)).first()[0] or []
    bucket = F.size(F.filter(F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<bigint>"), lambda c: c < F.col("doc_id")))
    ids = ids.withColumn("bucket", bucket)
    heads = ids.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    one = Window.orderBy("bucket")  # one row per cut
    heads = heads.select("bucket", F.coalesce(F.lag("top").over(one), F.max("top").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("carried"))
    ids = ids.withColumn("below", F.lag("doc_id").over(Window.partitionBy("bucket").orderBy("doc_id")))
    return ids.join(F.broadcast(heads), "bucket").select("doc_id", F.coalesce("below", "carried").alias("next_id"), "need")


def edited(docs: DataFrame, *, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they and the next document's are.

    Where a ``doc_id`` repeats, every row is compared with the row of the next id whose text hash is smallest; a row without
    ``doc_id`` has an empty text as its next.
    """
    none = F.lit((1 << 63) - 1)  # stands for a missing id: a key without nulls keeps the two sides of the exchange alike
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = winnow(rows, F.col("text"), k=k, window=window).repartition("doc_id")  # both sides below read this one exchange
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    after = next_ids(docs).select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), "need")
    heads = (base.withColumn("nth", first).filter("nth = 1").join(after, "doc_id")
             .select(F.col("for_id").alias("doc_id"), F.expr("left(text, cast(need AS INT))").alias("head"), hashes(F.col("marks")).alias("next_hashes")))
    d = base.join(heads, "doc_id", "left").withColumn("n_chars", F.length("text").cast("long"))
    third = F.expr("cast(floor(n_chars / 3) AS INT)")
    d = d.withColumn("new_text", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 3) AS INT))"), F.substring(F.coalesce("head", F.lit("")), F.lit(1), third))).drop("text", "head")
    d = winnow(d, F.col("new_text"), "new_marks", k=k, window=window)
    d = d.select("doc_id", "n_chars", F.sha2("new_text", 256).alias("edited_sha256"), "marks", "new_marks", hashes(F.col("marks")).alias("own"), hashes(F.col("new_marks")).alias("new"),
                 F.coalesce("next_hashes", F.array().cast("array<bigint>")).alias("next_hashes"))
    return d.select(F.nullif("doc_id", none).alias("doc_id"), "n_chars", "edited_sha256", shown(F.col("marks")).alias("fingerprint"), shown(F.col("new_marks")).alias("edited_fingerprint"),
                    likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next_hashes")).alias("near_next"))
