"""Operator 2: mixing sources to target weights, in DataFrame functions only.

The words of a source are packed, document after document, into blocks of fixed length; the last may be short.  A source's target decides how
many slots it fills: whole passes over its blocks, then as many slots of one more pass as the rest needs, the last of them cut short, so
that the words taken equal the target.  Output slots are grouped into shards: every slot of a source draws its shard at random, so
the counts of a source over the shards are multinomial with the total that the target fixes.  (Counts drawn shard by shard
from the weights alone would leave small sources far from their targets, and capped ones always below.)  The slots of a source are then
numbered over the shards and go through the source's pseudorandom permutation of block indices (another one per pass), and slots and
blocks are joined by source and index.

Sizes, slots and orders are never taken over a whole source in one task: documents of a source are dealt over ``PARTS`` parts by a hash
of their id, slots over chunks and shards over groups of ``GROUP``, with one sum per part or group to carry on from.  Only the table of
sources, one row each, is put in one order, which the weights ask for.

Defined results: a null text has no words, a null source is a source of its own (the last); sources without words have target 0;
equal targets and reruns give equal results; an empty table gives an empty mix; repeated rows are documents of their own; further columns
stay under their names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm.common import col, count_words, words_of
from quire.session import checkpointed, shared_folder

BLOCK, SHARD, PASSES, WEIGHTS = 128, 1024, 3, (5, 2, 1)
PARTS, GROUP, CHUNK, ROUNDS = 1024, 1024, 1 << 16, 24


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """Per source: size, weight and target.  Weights share all words; no target exceeds ``passes`` times its source.

    Filling up to a common level: with sources in order of ``passes * size / weight``, the first that its share does not exceed
    sets the level for all after it.  One row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = s.withColumn("weight", F.element_at(F.lit(list(weights)), (turn + 1).cast("int")).cast("double")).withColumn("key", _key(F.col("source")))
    s = s.withColumns({"cap": F.col("source_size") * float(passes), "full": F.col("source_size") * float(passes) / F.col("weight")})
    order = Window.orderBy("full", "key")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(on))
    s = s.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("full"), F.col("level")), F.when(F.col("level") <= F.col("full"), F.struct("full", "key"))).over(everything))
    return s.select("source", "key", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _numbered(df: DataFrame, group: list[str], part: str, order: list[str], size: str, out: str) -> DataFrame:
    """Add ``out``, the sum of ``size`` over the rows of the group before each row, in order of ``part`` and ``order``."""
    sums = df.groupBy(*group, part).agg(F.sum(size).alias("__sum"))
    start = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, part, F.coalesce(F.sum("__sum").over(start), F.lit(0)).alias("__start"))
    inner = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("__own", F.coalesce(F.sum(size).over(inner), F.lit(0))).join(sums, [*group, part])
            .withColumn(out, F.col("__own") + F.col("__start")).drop("__own", "__start"))


def permuted(x: Column, n: Column, *seed: Column, back: bool = False) -> Column:
    """Place of ``x`` in a pseudorandom permutation of 0 .. n - 1 (rounds of "swap or not", each its own inverse); ``back``: the ``x`` of a place."""
    def step(x, r):
        other = F.pmod(F.pmod(F.xxhash64(*seed, r), n) - x, n)
        return F.when(F.xxhash64(*seed, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def pack(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Parts of blocks: for each row (row, doc_id, key, size) the blocks its words fall in: ``block``, place in the block (``offset``), first word in the row and number of words."""
    d = rows.filter("size > 0").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    d = _numbered(d, ["key"], "part", ["doc_id", "size", "row"], "size", "at")
    d = d.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")))
    first, offset = F.greatest(F.lit(0), F.col("block") * block - F.col("at")), F.greatest(F.lit(0), F.col("at") - F.col("block") * block)
    return d.select("row", "key", "block", offset.alias("offset"), first.alias("first"), (F.least(F.col("size"), (F.col("block") + 1) * block - F.col("at")) - first).alias("words"))


def quotas(goal: DataFrame, *, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """Per source with a target: ``n_blocks``, the number of ``slots``, and the words of the last slot (``rest``)."""
    s = goal.filter("target > 0 AND source_size > 0").select("key", "source_size", F.round("target").cast("long").alias("goal"))
    s = s.withColumns({"n_blocks": F.ceil(F.col("source_size") / block), "passes": F.expr("goal div source_size"), "left": F.expr("goal % source_size")})
    # the short block stands at place ``short`` of the last pass
    s = s.withColumn("lack", F.col("n_blocks") * block - F.col("source_size"))
    s = s.withColumn("short", permuted(F.col("n_blocks") - 1, F.col("n_blocks"), F.lit(seed), F.col("key"), F.col("passes"), back=True))
    early = F.col("left") <= F.col("short") * block
    m = F.when(early, F.ceil(F.col("left") / block)).otherwise(F.greatest(F.col("short") + 1, F.ceil((F.col("left") + F.col("lack")) / block)))
    s = s.withColumn("m", m)
    rest = F.col("left") - (F.col("m") - 1) * block + F.when(F.col("m") - 1 > F.col("short"), F.col("lack")).otherwise(0)
    return s.select("key", "n_blocks", (F.col("passes") * F.col("n_blocks") + F.col("m")).alias("slots"), F.when(F.col("m") > 0, rest).otherwise(block).alias("rest")).filter("slots > 0")


def slots(goal: DataFrame, *, block: int = BLOCK, shard: int = SHARD, seed: int = 1) -> DataFrame:
    """Output slots: ``shard``, ``nth`` in its source there, ``key``, ``block``, ``pass`` and ``upto``, the words of the block it may take."""
    own = checkpointed(quotas(goal, block=block, seed=seed))
    shards = -(-(own.agg(F.sum("slots")).first()[0] or 0) // shard) or 1
    chunks = own.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {CHUNK}")))).repartition("key", "chunk")
    draws = chunks.select("key", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("i"))
    draws = draws.select("key", F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), "key", "i"), F.lit(shards)).alias("shard"))
    counts = draws.groupBy("shard", "key").agg(F.count("*").alias("n"))
    counts = _numbered(counts.withColumn("group", F.expr(f"shard div {GROUP}")), ["key"], "group", ["shard"], "n", "before")
    each = counts.join(own, "key").repartition("key", "shard").withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = each.withColumn("k", F.col("before") + F.col("nth")).withColumn("pass", F.expr("k div n_blocks"))
    place = permuted(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("key"), F.col("pass"))
    upto = F.when(F.col("k") == F.col("slots") - 1, F.col("rest")).otherwise(block)
    return each.select("shard", "nth", "key", place.alias("block"), "pass", upto.alias("upto"))


def _sized(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", count_words(col(text)).alias("size"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes of it (repeats counted)."""
    block = how.get("block", BLOCK)
    rows = checkpointed(_sized(docs, "text")).withColumn("key", _key(F.col("source")))
    goal = checkpointed(targets(rows))
    whole = F.col("upto") == block
    times = slots(goal, **how).groupBy("key", "block").agg(F.count_if(whole).alias("times"), F.max(F.when(~whole, F.col("upto"))).alias("upto"))  # a source cuts one slot
    some = F.greatest(F.lit(0), F.least(F.col("words"), F.coalesce("upto", F.lit(0)) - F.col("offset")))
    taken = pack(rows, block).join(times, ["key", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times") + some).alias("taken"))
    return (rows.join(taken, "row", "left").join(goal.select("key", "source_size", "target"), "key")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed(docs: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words of it, with those words (all: the text as it was)
    in place of ``text``.  Other columns stay; ``doc_id`` repeats where a later pass takes the document again."""
    import uuid

    spark, block = docs.sparkSession, how.get("block", BLOCK)
    path = f"{shared_folder(spark)}/mixing-{uuid.uuid4().hex}"  # fixes the row numbers
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # input columns stand under numbers meanwhile: no name can clash
    docs.toDF(*at.values()).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.schema(docs.toDF(*at.values()).withColumn("row", F.lit(0).cast("long")).schema).parquet(path)
    body = F.col(at[text]).cast("string")
    rows = checkpointed(kept.select("row", F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), count_words(body).alias("size"))).withColumn("key", _key(F.col("source")))
    goal = checkpointed(targets(rows))
    # a block that slots take in one pass is taken once in it, so its parts of documents meet one row
    parts = pack(rows, block).join(slots(goal, **how).select("key", "block", "pass", "upto"), ["key", "block"])
    parts = parts.withColumn("words", F.least(F.col("words"), F.col("upto") - F.col("offset"))).filter("words > 0")
    some = parts.groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct(F.col("first").cast("int").alias("first"), F.col("words").cast("int").alias("words")))).alias("parts"), F.sum("words").alias("words"))
    w = F.col("w")
    out = kept.join(some, "row").withColumn("w", words_of(body))
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(w, p["first"] + 1, p["words"]))), " ")
    out = out.withColumn("taken", F.when(F.size(w) == F.col("words"), body).otherwise(cut))
    return out.select(*[F.col("taken" if c == text else n).alias(c) for c, n in at.items()])
