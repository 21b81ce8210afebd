"""Near-duplicates by SimHash: documents whose sets of five-word shingles have a Jaccard likeness of at least 0.8.

At a likeness of 0.8 two SimHash fingerprints differ in 15 % of their bits, ten of 64, which no choice of equal blocks of 64 bits finds.
Fingerprints here have 2048 bits.  Of the first 504, 42 blocks of 12 bits are made: a pair of likeness 0.8 agrees on a block with
probability 0.139, hence on one or more of the 42 with 0.998.  Pairs that share a block, differ in at most ``NEAR`` of the first 256 bits and
in at most ``WITHIN`` of all are candidates; every candidate is verified on the shingles, in whole numbers.  A pair that shares several
blocks is a candidate in the first of them.

Work is done on distinct sets of shingles, in two steps whatever the size of a bucket:

1. A bucket of up to ``LIMIT`` sets (or each part of a larger one) gives all its pairs, or where they are many the shortest forest that
   connects what they connect.  These are verified and connected.
2. Of the larger buckets and those with many pairs, those remain whose sets are not all connected.  There every set outside the
   bucket's largest group is compared with every set of another group; parts of the bucket, of ``WORK`` comparisons each, go to different
   tasks.  So a large group of near copies costs a few times its size, and no candidate is left out.

Both steps have the same candidates, so groups do not depend on the sizes of buckets.  A bucket of very many unlike sets is compared in
full: work that grows with the square of the bucket, in parts of bounded size.

Defined results: letters A-Z are lower-cased; a text of fewer words than a shingle is one shingle; texts without words, nulls included, are alike;
of each group the row of the smallest ``doc_id`` stays (a null one is the last, then the text's hash decides); of repeated rows, one;
an empty table stays empty; all columns stay under their names, whatever they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import col, pieces
from quire.llm.simhash import _LOWER, components
from quire.session import checkpointed

SIZE, WORDS = 5, 32
#: Words of the fingerprint that a bucket's rows carry.
SHORT = 4
#: Bits of these words and of all words that a candidate may differ in: 2.6 and 3.6 deviations above the mean at likeness 0.8.
NEAR, WITHIN = 54, 368
#: Blocks, hexadecimal digits in a block, and steps at most.
BLOCKS, DIGITS, LEVELS = 42, 3, 2
#: Sets in a bucket that are compared at once, and comparisons of one task in the second step.
LIMIT, WORK = 8192, 1 << 26
#: Bits of the first two words that a candidate may differ in; 5.6 deviations above the mean at likeness 0.8.
FIRST = 42
#: Bits of the map of wanted texts.
MARKS = 1 << 22
_SEEDS = np.random.default_rng(5).integers(0, 1 << 64, WORDS, np.uint64)
_ODD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingles_of(text: str, size: int = SIZE) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    k = max(1, len(words) - size + 1) if words else 0
    return np.array(sorted({xxh64_intdigest(b" ".join(words[i:i + size]), 42) for i in range(k)}), np.uint64)


def fingerprint_of(hashes: np.ndarray) -> bytes:
    """SimHash of a set of hashes: the majority of every bit of 64 * ``WORDS``; zeros for the empty set."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 255 * 8):
        x = hashes[at:at + 255 * 8, None] ^ _SEEDS
        x = (x ^ (x >> np.uint64(30))) * _ODD[0]
        x = (x ^ (x >> np.uint64(27))) * _ODD[1]
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums that fit in a byte
            ones += bits[k:k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def _described(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, body, sig, fp): name of the set of shingles and its fingerprint."""
    from xxhash import xxh3_64_intdigest

    for batch in pieces(batches, "text"):
        sets = [shingles_of(t, size) for t in batch.column("text").to_pylist()]
        sig = np.array([xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), pa.array(sig), pa.array([fingerprint_of(h) for h in sets], pa.binary())], ["doc_id", "body", "sig", "fp"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (sig, shingles, fp)."""
    for batch in pieces(batches, "text"):
        found = [shingles_of(t, size).view(np.int64) for t in batch.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        fps = _words(batch.column("fp"), WORDS).view(np.int64)
        whole = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * WORDS), pa.array(fps.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))), whole], ["sig", "shingles", "fp"])


def _words(column: pa.Array, words: int) -> np.ndarray:
    """Fingerprints of an Arrow column, one row of words each."""
    if not len(column):
        return np.zeros((0, words), np.uint64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].tobytes(), np.uint64).reshape(-1, words)


def _blocks(fps: np.ndarray) -> np.ndarray:
    """Values of the blocks that lie within the words given."""
    digits = np.stack((fps.view(np.uint8) >> 4, fps.view(np.uint8) & 15), axis=-1).reshape(len(fps), -1).astype(np.uint16)
    n = min(BLOCKS, digits.shape[1] // DIGITS)
    digits = digits[:, :n * DIGITS].reshape(len(fps), n, DIGITS)
    return (digits[:, :, 0] << 8) | (digits[:, :, 1] << 4) | digits[:, :, 2]


def _close(x: np.ndarray, y: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows of ``x`` and of ``y`` that are near in the words given; None where these are more than ``most``."""
    found, n = [(np.zeros(0, np.int64),) * 2], 0
    step = max(1, (1 << 18) // max(1, len(y)))
    for at in range(0, len(x), step):
        part = x[at:at + step]
        few = np.bitwise_count(part[:, None, 0] ^ y[None, :, 0]) + np.bitwise_count(part[:, None, 1] ^ y[None, :, 1])
        i, j = np.nonzero(few <= FIRST)
        for k in range(0, len(i), 1 << 15):
            p, q = i[k:k + (1 << 15)] + at, j[k:k + (1 << 15)]
            d = np.bitwise_count(x[p] ^ y[q])
            ok = d[:, :SHORT].sum(axis=1, dtype=np.int64) <= NEAR
            if d.shape[1] > SHORT:
                ok &= d.sum(axis=1, dtype=np.int64) <= WITHIN
            found.append((p[ok], q[ok]))
            n += int(ok.sum())
            if most is not None and n > most:
                return None
    return tuple(np.concatenate(v) for v in zip(*found))


def _first_meeting(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those that share no block before ``block``."""
    if not block:
        return i, j
    before, after = _blocks(x)[:, :block], _blocks(y)[:, :block]
    new = [~(before[i[k:k + (1 << 15)]] == after[j[k:k + (1 << 15)]]).any(axis=1) for k in range(0, len(i), 1 << 15)]
    new = np.concatenate(new) if new else np.zeros(0, bool)
    return i[new], j[new]


def _forest(sig: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shortest forest that connects the rows which near pairs connect, in memory of the rows' number.

    Pairs of equal distance go by their names, so that buckets which share sets give the same links.
    """
    n, far = len(fps), np.iinfo(np.uint64).max
    words, names = [np.ascontiguousarray(fps[:, k]) for k in range(SHORT)], sig.view(np.uint64)
    best, by, out = np.full(n, far), np.zeros(n, np.int64), np.ones(n, bool)
    links: list[tuple[int, int]] = []
    for _ in range(n):
        v = int(best.argmin())
        if best[v] == far:
            v = int(out.argmax())  # nothing is near what is connected: another tree
        else:
            links.append((int(by[v]), v))
        out[v], best[v] = False, far
        d = np.bitwise_count(words[0] ^ words[0][v]) + np.bitwise_count(words[1] ^ words[1][v])
        near = out & (d <= FIRST)
        d = d.astype(np.uint64)
        for w in words[2:]:
            d += np.bitwise_count(w ^ w[v])
        key = (d << np.uint64(48)) | ((names ^ names[v]) >> np.uint64(16))
        near &= (d <= NEAR) & (key < best)
        best[near], by[near] = key[near], v
    both = np.array(links, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs (a, b) of each row's ``sets``; where they are many a forest of them, with the bucket in ``again``."""
    for batch in batches:
        lists = batch.column("sets")
        offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
        offsets = offsets - offsets[0]
        sig, fps = flat.field("sig").to_numpy(zero_copy_only=False), _words(flat.field("fp"), SHORT)
        a, b, again = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, bucket in enumerate(batch.column("bucket").to_pylist()):
            own = slice(offsets[k], offsets[k + 1])
            x, names = fps[own], sig[own]
            found = _close(x, x, 9 * len(x))
            if found is None:
                i, j = _forest(names, x)
            else:
                i, j = _first_meeting(x, x, *found, bucket >> 4 * DIGITS)
                i, j = i[i < j], j[i < j]
            a.append(names[i])
            b.append(names[j])
            again.append(np.full(len(i), bucket if found is None else -1))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, again)], ["a", "b", "again"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) between the sets of a part and those outside the bucket's largest group, of different groups."""
    for batch in batches:
        for bucket, own in zip(batch.column("bucket").to_pylist(), batch.column("sets")):
            flat = own.values
            sig, root = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("sig", "root"))
            away, fps = flat.field("away").to_numpy(zero_copy_only=False).astype(bool), _words(flat.field("fp"), WORDS)
            x, y = np.flatnonzero(away), np.flatnonzero(~away)
            for at in range(0, len(x) if len(y) else 0, 1024):
                some = x[at:at + 1024]
                i, j = _close(fps[some], fps[y])
                other = root[some[i]] != root[y[j]]
                i, j = _first_meeting(fps[some], fps[y], i[other], j[other], bucket >> 4 * DIGITS)
                i, j = some[i], y[j]
                pairs = np.unique(np.stack((np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _cut(fps: DataFrame) -> DataFrame:
    """Rows (bucket, sig, fp) for every block of every set (sig, fp)."""
    rows = fps.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("value", F.conv(F.substring(F.hex(F.substring("fp", 1, 64)), F.col("k") * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("long"))
    return rows.select((F.col("k") * (1 << 4 * DIGITS) + F.col("value")).cast("long").alias("bucket"), "sig", F.substring("fp", 1, 8 * SHORT).alias("fp"))


def _marked(wanted: DataFrame) -> Column:
    """Condition on ``body`` that holds for all wanted rows and for few others: a bit map of fixed size, so that most texts need not be
    shuffled to find out that they are not wanted."""
    bit = F.pmod("body", F.lit(MARKS))
    words = wanted.select(F.floor(bit / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(body, 64) AS INT))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    table = np.zeros(MARKS // 64, np.int64)
    for r in words.collect():  # at most MARKS / 64 rows
        table[r["w"]] = r["m"]
    shared = wanted.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def marked(body: pd.Series) -> pd.Series:
        at = np.mod(body.to_numpy(), MARKS)
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return marked("body")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) within ``WITHIN`` bits whose shingles have a likeness of at least 4/5."""
    one = lambda x: sets.select(F.col("sig").alias(x), F.col("shingles").alias(f"s{x}"), F.col("fp").alias(f"f{x}"))
    pairs = pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    bits = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    both = pairs.join(one("a"), "a").join(one("b"), "b").filter(bits <= WITHIN).withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.filter(9 * F.col("shared") >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def _roots(links: DataFrame) -> DataFrame:
    return checkpointed(components(links).withColumnRenamed("node", "sig"))


def similar(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = SIZE, limit: int = LIMIT, work: int = WORK) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, body, sig) of ``docs``, where ``body`` is the text's hash, and the root of every ``sig`` that is linked to another."""
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    src = docs.select(col(key).alias("doc_id"), F.xxhash64(body).alias("body"), body.alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    own = checkpointed(src.mapInArrow(lambda it: _described(it, size), f"doc_id {kind}, body long, sig long, fp binary"))
    each = checkpointed(own.groupBy("sig").agg(F.min(F.struct("body", "doc_id")).alias("one"), F.first("fp").alias("fp")))
    own, fps = own.select("doc_id", "body", "sig"), each.select("sig", "fp")
    side = max(1, min(limit, math.isqrt(work)))  # rows of a part in the second step
    parts = lambda n, size: F.ceil(F.col(n) / size)
    share = lambda n, size: F.pmod(F.xxhash64("sig"), parts(n, size))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), parts(n, side) - 1))

    rows = _cut(fps)
    large = checkpointed(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > limit))
    none = large.isEmpty()
    dealt = rows.withColumn("part", F.lit(0)) if none else rows.join(large, "bucket", "left").withColumn("part", F.coalesce(share("n", limit), F.lit(0)))
    found = dealt.groupBy("bucket", "part").agg(F.collect_list(F.struct("sig", "fp")).alias("sets")).filter(F.size("sets") > 1)
    found = checkpointed(found.select("bucket", "sets").mapInArrow(_in_buckets, "a long, b long, again long"))
    pairs, open_ = found.select("a", "b"), found.filter("again != -1").select(F.col("again").alias("bucket")).distinct()
    wanted = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig")))
    if not none:
        open_ = open_.unionByName(large.select("bucket")).distinct()
        wanted = wanted.unionByName(rows.join(large, "bucket").select("sig"))
    wanted = each.join(wanted.distinct(), "sig").select("sig", F.col("one.body").alias("body"), F.col("one.doc_id").alias("own_id"), "fp")
    some = src.filter(_marked(checkpointed(wanted)))
    texts = some.join(wanted, (some["body"] == wanted["body"]) & some["doc_id"].eqNullSafe(wanted["own_id"])).select("sig", "text", "fp").dropDuplicates(["sig"])
    sets = checkpointed(texts.mapInArrow(lambda it: _sets(it, size), "sig long, shingles array<long>, fp array<long>"))
    links, open_ = checkpointed(_alike(pairs, sets)), checkpointed(open_)
    roots = _roots(links)
    if open_.isEmpty():
        return own, roots
    # what is left: sets of open buckets that are not connected to the largest group there
    rooted = rows.drop("fp").join(open_, "bucket").join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    groups = rooted.groupBy("bucket", "root").agg(F.count("*").alias("m"))
    stats = groups.groupBy("bucket").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("top"))
    stats = stats.select("bucket", "n", F.col("top.root").alias("top"), (F.col("n") - F.col("top.m")).alias("out")).filter("out > 0")
    left = checkpointed(rooted.join(stats, "bucket"))
    if left.isEmpty():
        return own, roots
    now = left.join(fps, "sig")
    mine = now.select("bucket", "sig", "fp", "root", "out", share("n", side).alias("p"), F.lit(False).alias("away")).withColumn("q", every("out"))
    away = now.filter("root != top").select("bucket", "sig", "fp", "root", "n", share("out", side).alias("q"), F.lit(True).alias("away")).withColumn("p", every("n"))
    met = mine.drop("out").unionByName(away.drop("n")).groupBy("bucket", "p", "q").agg(F.collect_list(F.struct("sig", "fp", "root", "away")).alias("sets")).select("bucket", "sets")
    more = _alike(met.mapInArrow(_across, "a long, b long"), sets)
    return own, _roots(links.unionByName(more))


def keep_first(docs: DataFrame, *, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """One row of each group of near-duplicates."""
    own, roots = similar(docs, text=text, key=key, **how)
    least = lambda c: F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias(c)
    each = own.groupBy("sig").agg(least("first")).join(roots, "sig", "left").select(F.coalesce("root", "sig").alias("root"), "first.*")
    stay = each.groupBy("root").agg(least("first")).select(F.col("first.doc_id").alias("k"), F.col("first.body").alias("b"))
    # input columns stand under numbers meanwhile: no name can clash
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    at = {c: n for c, n in zip(docs.columns, names)}
    name = lambda c: F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n"))
    # join and removal of repeated rows need one exchange of the texts
    rows = rows.withColumns({"body": F.xxhash64(F.coalesce(F.col(at[text]).cast("string"), F.lit(""))), "id": name(F.col(at[key]))})
    rows = rows.join(stay.select(F.col("b").alias("body"), name(F.col("k")).alias("id")), ["body", "id"], "left_semi").dropDuplicates(["body", "id"])
    return rows.select(*[F.col(n).alias(c) for c, n in at.items()])
