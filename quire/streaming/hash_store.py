"""De-duplicated ingest against a store of content hashes that grows with every batch.

The store keeps one hash per text ever taken in, in segments partitioned by a hash bucket, and beside each segment a Bloom filter per bucket
as a table of 64-bit words: filters are made with ``bit_or`` over partial sums, merged the same way, and looked up by a join on bucket and word.
A batch asks the filters first; only buckets in which some hash may be known are read, and only those hashes are compared exactly.

A copy is found however late it comes: no watermark bounds the memory.  Output and store of a batch become visible together, by the manifest's
commit; a replayed batch that was committed does nothing, one that was not is written anew from the same state.  Segments of like size are
merged, so their number stays logarithmic.

Defined results: a null text counts as an empty one; of copies in one batch the earliest by ``ts`` stays (a null time last; then by a hash of
the row); rows of an empty batch are none; the schema of a batch is that of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.streaming.segments import commit, due_segments, manifest

BUCKETS, BITS, PROBES, FAN = 32, 1 << 18, 4, 4
_HASHES, _WORDS = "hash string, bucket int", "bucket int, word int, bits long"


def _hash() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int")


def _probes(rows: DataFrame, bits: int) -> DataFrame:
    """Rows (hash, bucket, word, mask): the filter bits of every hash."""
    bit = F.explode(F.array(*(F.pmod(F.xxhash64("hash", F.lit(k)), F.lit(bits)) for k in range(1, PROBES + 1))))
    rows = rows.select("hash", "bucket", bit.alias("bit"))
    return rows.select("hash", "bucket", F.floor(F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 AS INT))").alias("mask"))


def _read(spark: SparkSession, root: str, table: str, schema: str, names: list[str]) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for n in names:
        out = out.unionByName(spark.read.schema(schema).parquet(f"{root}/{table}/{n}"))
    return out


def maybe_known(rows: DataFrame, words: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows (hash, bucket) that the filters do not rule out."""
    asked = _probes(rows.select("hash", "bucket").distinct(), bits).join(words, ["bucket", "word"], "left")
    hit = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) != 0, F.lit(False))
    return asked.groupBy("hash", "bucket").agg(F.bool_and(hit).alias("maybe")).filter("maybe").select("hash", "bucket")


def _write(spark: SparkSession, root: str, name: str, hashes: DataFrame, bits: int, words: DataFrame | None = None) -> int:
    hashes.repartition("bucket").sortWithinPartitions("hash").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/hashes/{name}")
    written = spark.read.schema(_HASHES).parquet(f"{root}/hashes/{name}")
    if words is None:
        words = _probes(written, bits).select("bucket", "word", F.col("mask").alias("bits"))
    words.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits")).write.mode("overwrite").parquet(f"{root}/words/{name}")
    return written.count()


def take_in(spark: SparkSession, root: str, batch: DataFrame, batch_id: int, *, ts: str = "ts", buckets: int = BUCKETS, bits: int = BITS, fan: int = FAN) -> list[int]:
    """One micro-batch with a ``text``: its new texts go to the output, their hashes to the store.  Returns the buckets that were read."""
    number, segments = manifest(spark, root)
    if number >= batch_id:
        return []
    names = [s for s, _ in segments]
    # the batch is written first, so that output and store are of the same rows
    batch.withColumn("hash", _hash()).withColumn("bucket", _bucket(buckets)).write.mode("overwrite").parquet(f"{root}/batch/{batch_id}")
    rows = spark.read.schema(batch.withColumn("hash", F.lit("")).withColumn("bucket", F.lit(0)).schema).parquet(f"{root}/batch/{batch_id}")
    order = [F.col(ts).asc_nulls_last()] if ts in batch.columns else []
    first = F.row_number().over(Window.partitionBy("hash").orderBy(*order, F.xxhash64(*batch.columns)))
    rows = rows.withColumn("__nth", first).filter("__nth = 1").drop("__nth")
    words = _read(spark, root, "words", _WORDS, names).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    maybe = maybe_known(rows, words, bits)
    read = sorted(r["bucket"] for r in maybe.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    known = _read(spark, root, "hashes", _HASHES, names).filter(F.col("bucket").isin(read)) if read else spark.createDataFrame([], _HASHES)
    known = known.join(maybe, ["bucket", "hash"], "left_semi").select("hash")
    new = rows.join(known, "hash", "left_anti")
    new.drop("bucket").write.mode("overwrite").parquet(f"{root}/out/{batch_id}")
    new = spark.read.schema(rows.drop("bucket").schema).parquet(f"{root}/out/{batch_id}")
    n = _write(spark, root, f"b{batch_id}", new.select("hash").withColumn("bucket", _bucket(buckets)), bits)
    segments = segments + [(f"b{batch_id}", n)] * bool(n)
    made = 0
    while due := due_segments(segments, fan):
        name = f"m{batch_id}-{made}"
        n = _write(spark, root, name, _read(spark, root, "hashes", _HASHES, due), bits, _read(spark, root, "words", _WORDS, due))
        segments = [(s, k) for s, k in segments if s not in due] + [(name, n)]
        made += 1
    commit(spark, root, batch_id, segments)
    return read


def seed(spark: SparkSession, root: str, known: DataFrame, *, buckets: int = BUCKETS, bits: int = BITS) -> None:
    """Start a store with known hashes (a ``hash`` column), as commit 0; batches begin at 1."""
    n = _write(spark, root, "b0", known.select("hash").distinct().withColumn("bucket", _bucket(buckets)), bits)
    commit(spark, root, 0, [("b0", n)] * bool(n))


def documents(spark: SparkSession, root: str, schema, first_batch: int = 0) -> DataFrame:
    """All texts taken in by committed batches, with ``hash``; ``schema`` is that of a batch."""
    number, _ = manifest(spark, root)
    out = spark.createDataFrame([], schema).withColumn("hash", F.lit(""))
    paths = [f"{root}/out/{k}" for k in range(first_batch, number + 1)]
    return spark.read.schema(out.schema).parquet(*paths) if paths else out


def run(arrivals: DataFrame, root: str, checkpoint: str, *, first_batch: int = 0, trigger: dict | None = None, **how) -> StreamingQuery:
    """Start the ingest of a stream; with a new checkpoint an existing store is continued from ``first_batch``."""
    def step(batch: DataFrame, batch_id: int) -> None:
        take_in(batch.sparkSession, root, batch, first_batch + batch_id, **how)

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
