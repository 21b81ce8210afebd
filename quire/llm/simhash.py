"""Operator 7: SimHash near-duplicates through pigeonhole blocks.

A fingerprint holds the majority bit of its shingles' hashes at each of 64 places.  Two fingerprints that differ in at most four
bits agree on at least two of six blocks, so pairs meet on the fifteen two-block keys and the distance is then verified.  Work is
done on distinct fingerprints.  A bucket of more than ``BUCKET`` fingerprints is not searched as a whole: the pigeonhole is applied again
to the bits the key leaves open (eight parts, four of them equal), and once more (seven parts, three equal), after which a
bucket cannot hold more than 2^12 fingerprints.  A bucket gives a spanning forest of its close pairs, not all of them; that
keeps every connection and never a group's square.

Defined results: null, empty and blank texts have no words and the fingerprint zero; a text of fewer words than a shingle is one
shingle; repeated rows stay and share a component; a null ``doc_id`` never names a component unless nothing else does; empty
input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import col, others, pieces, schema_with
from quire.session import checkpointed

BITS = 64
#: Fingerprints in a bucket that one task compares with each other.
BUCKET = 256
#: Blocks and equal blocks of each round; with ``n`` blocks, ``n - 4`` are equal in a pair within four bits.
ROUNDS = ((6, 2), (8, 4), (7, 3))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint_of(text: str, size: int) -> int:
    """Unsigned 64-bit SimHash of one text (lower-cased A-Z, shingles of ``size`` words, repeats included)."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, len(words) - size + 1)
    first, last = starts[:k].tolist(), ends[len(words) - k:].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, k, 1 << 15):
        some = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(first[at:at + (1 << 15)], last[at:at + (1 << 15)])], "<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > k, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", size: int = 4, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``fp`` (the 64 bits as a long) to each row."""
    src = docs.select(*others(docs, ["fp", "__text"], drop), col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            fps = np.array([fingerprint_of(t or "", size) for t in batch.column("__text").to_pylist()], "<u8").view("<i8")
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fps)], [*names, "fp"])

    return src.mapInArrow(run, schema_with(src.drop("__text"), fp="long"))


def block_masks(free: int, parts: int, equal: int) -> list[int]:
    """Masks of every choice of ``equal`` blocks out of ``parts`` that the set bits of ``free`` are cut into."""
    bits = [b for b in range(BITS) if free >> b & 1]
    cuts = [bits[len(bits) * i // parts: len(bits) * (i + 1) // parts] for i in range(parts)]
    return [sum(1 << b for block in chosen for b in block) for chosen in combinations(cuts, equal)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask_rows() -> list[list[tuple[int, int, int]]]:
    """For each round the rows (key of the round before, key, mask); the numbers follow from ROUNDS alone."""
    rounds, before = [], [(0, 0)]
    for parts, equal in ROUNDS:
        rows = []
        for parent, mask in before:
            rows += [(parent, mask | m) for m in block_masks(((1 << BITS) - 1) & ~mask, parts, equal)]
        rounds.append([(parent, k, _signed(mask)) for k, (parent, mask) in enumerate(rows)])
        before = [(k, mask) for k, (_, mask) in enumerate(rows)]
    return rounds


def _forest(fps: np.ndarray, within: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the pairs at most ``within`` bits apart."""
    left = fps
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= within
            found = left[near]
            for y in found.tolist():
                yield int(x), y
            todo.extend(found)
            left = left[~near]


def _bucket_edges(batches: Iterator[pa.RecordBatch], within: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("fps")
        values, offsets = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        size = np.diff(offsets)
        two = offsets[:-1][size == 2]  # most buckets hold two
        two = two[np.bitwise_count(values[two] ^ values[two + 1]) <= within]
        a, b = [values[two]], [values[two + 1]]
        for i in np.flatnonzero(size > 2):
            pairs = np.array(list(_forest(values[offsets[i]:offsets[i + 1]], within)), np.uint64).reshape(-1, 2)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def close_links(fps: DataFrame, within: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct values of ``fp`` that connect exactly what pairs within ``within`` (up to four) bits connect."""
    spark, links = fps.sparkSession, None
    keys = fps.select(F.lit(0).alias("key"), F.lit(0).cast("long").alias("value"), "fp")
    for number, rows in enumerate(_mask_rows()):
        masks = F.broadcast(spark.createDataFrame(rows, "key int, next int, mask long"))  # a fixed number of rows
        keys = keys.join(masks, "key").select(F.col("next").alias("key"), F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
        sizes = keys.groupBy("key", "value").agg(F.count("*").alias("n")).filter("n > 1")
        last = number == len(ROUNDS) - 1
        small = keys.join(sizes if last else sizes.filter(F.col("n") <= bucket), ["key", "value"])
        found = (small.groupBy("key", "value").agg(F.collect_list("fp").alias("fps")).select("fps")
                 .mapInArrow(lambda it: _bucket_edges(it, within), "a long, b long"))
        links = found if links is None else links.unionByName(found)
        if last:
            break
        large = checkpointed(sizes.filter(F.col("n") > bucket).drop("n"))
        if large.isEmpty():
            break
        keys = keys.join(large, ["key", "value"])
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """Root (the smallest member) of every node of ``links`` (a, b): large and small stars in turn until nothing changes."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    state = None
    while True:
        near = both(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = edges.filter("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        edges = (down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        edges = checkpointed(edges)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod("b", F.lit(1 << 20)))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, *, text: str = "text", size: int = 4, within: int = 4, key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fp`` and ``component_id``, the smallest ``doc_id`` reachable over close fingerprints."""
    own = checkpointed(fingerprints(docs.select(col(key).alias("doc_id"), col(text).alias("__body")), text="__body", size=size, drop=("__body",)))
    each = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(close_links(each.select("fp"), within))
    each = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = each.groupBy("root").agg(F.min("first").alias("component_id"))
    each = each.join(names, "root").select("fp", "component_id")
    # a fingerprint that many rows share meets one row of ``each``: adaptive execution splits it
    return own.join(each, "fp").select("doc_id", "fp", "component_id")


def classes(docs: DataFrame) -> DataFrame:
    """Fingerprint (hexadecimal) and component of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """Documents that name their component: one of each group of near-duplicates (of repeated rows, one).  Rows without ``doc_id`` stay."""
    key = how.get("key", "doc_id")
    found = near_duplicates(docs, **how)
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__stay")).distinct()
    named = docs.join(stay, docs[key] == F.col("__stay"), "left_semi").dropDuplicates([key])
    return named.unionByName(docs.filter(col(key).isNull()))
