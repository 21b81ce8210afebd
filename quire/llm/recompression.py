"""Operator 4: removal of long repeated word sequences by recompression.

Words are named by hashes of their letters, so every task gives the same name without a table.  One round names runs of an equal
word, the next rounds name pairs: a symbol of the left class followed by one of the right class becomes one symbol (classes are a bit
of the name), so equal word sequences get equal symbols except near their ends.  Each symbol carries the interval of words its
identity depends on.  A window of ``size`` words elects, among the high-level symbols that it determines, the one with the smallest
name; the election depends on the window's words alone, so equal windows elect equal symbols.  Where a window determines none
(inside a long run, say) its own words are elected.

Neighbouring windows that elect the same symbol form a block, named by the symbol and by all the block's words (64 bits each).

1. Blocks are grouped by symbol.  A block with an earlier equal block is a repeat as a whole.  If all blocks of a symbol are equal,
   their windows stand nowhere else, and the first block is clean.
2. Where a symbol has different blocks (the ends of repeats), the windows of the first block of each kind are named by their
   words (128 bits), and all but the first window of a name are repeats.
3. Words covered by a repeat are removed.

Equal blocks or windows inside one Arrow piece are settled there: of a very frequent passage one row per piece is shuffled, so
no task gathers a passage's copies.  Only (hash, id, position) rows are shuffled, and the text once.

Defined results: null, empty and blank texts have no words; a text shorter than a window loses nothing; rows that share a ``doc_id`` are
parts of one document, in the order of a hash of their text (so a repeated row repeats the first); rows without ``doc_id`` come
last, by a hash of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from quire.llm.common import col, pieces, schema_with

SIZE, PAIR_ROUNDS = 20, 3
#: Bytes of text that a task names at once.
PIECE = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a piece of texts: flat array, names (two 64-bit halves) and the offsets of the texts."""

    def __init__(self, texts: pa.Array):
        from xxhash import xxh3_128_digest

        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
        doc = np.repeat(np.arange(len(sizes)), sizes)[real]
        self.flat = flat.filter(pa.array(real))
        self.offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(sizes))))).astype(np.int64)
        coded = self.flat.dictionary_encode()
        names = np.frombuffer(b"".join(xxh3_128_digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), "<u8").reshape(-1, 2)
        index = coded.indices.to_numpy(zero_copy_only=False)
        self.first, self.second = (names[index, 0], names[index, 1]) if len(index) else (np.zeros(0, np.uint64),) * 2


class Ranges:
    """Hash of any range of a sequence of names."""

    def __init__(self, names: np.ndarray):
        n = len(names) + 1
        up = np.full(n, _P)
        up[0] = 1
        down = np.full(n, _P_INVERSE)
        down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(names * np.multiply.accumulate(up)[:-1])))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed_bits((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def symbols(names: np.ndarray, offsets: np.ndarray, rounds: int = PAIR_ROUNDS) -> tuple[np.ndarray, ...]:
    """Symbols after the run round and ``rounds`` pair rounds: name, first word, and the interval [lo, hi) that determines it.

    ``lo`` and ``hi`` may lie outside the text: such a symbol depends on where the text ends.
    """
    n = len(names)
    starts_text = np.zeros(n + 1, bool)
    starts_text[offsets] = True
    new = starts_text[:n].copy()
    new[1:] |= names[1:] != names[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)[: len(start)]
    length = (end - start).astype(np.uint64)
    name = mixed_bits(names[start] + length * _P)
    lo, hi = start - 1, end + 1
    for level in range(rounds):
        if len(name) < 2:
            break
        left = (mixed_bits(name + np.uint64(level + 1)) & np.uint64(1)).astype(bool)
        joined = left[:-1] & ~left[1:] & ~starts_text[start[1:]]
        first = np.append(joined, False)
        second = np.insert(joined, 0, False)
        new_lo = np.where(left, lo, np.append(lo[:1], lo[:-1]))  # a right symbol also depends on the one before
        new_hi = np.where(left & ~first, np.append(hi[1:], hi[-1:]), hi)  # an unpaired left symbol on the one after
        at = np.flatnonzero(first)
        name = name.copy()
        name[at] = mixed_bits(name[at] * _P + mixed_bits(name[at + 1]))
        new_hi[at] = new_hi[at + 1]
        # at the ends of the piece what is outside decides
        if not left[0]:
            new_lo[0] = start[0] - 1
        if left[-1]:
            new_hi[-1] = n + 1
        keep = ~second
        name, start, lo, hi = name[keep], start[keep], new_lo[keep], new_hi[keep]
    return name, start, lo, hi


def elect(words: Words, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows (first word, text of it) and what each elects: symbol number, or -1; and the keys of the symbols' starts."""
    names, offsets = words.first, words.offsets
    count = np.maximum(np.diff(offsets) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + offsets[text]
    name, start, lo, hi = symbols(names, offsets)
    a, b = np.searchsorted(lo, at, "left"), np.searchsorted(hi, at + size, "right")
    chosen = np.where(a < b, a, -1)
    rank = mixed_bits(name ^ _P)
    open_ = np.flatnonzero(a + 1 < b)
    step = 1
    best = rank[a[open_]] if len(open_) else np.zeros(0, np.uint64)
    while len(open_):
        j = a[open_] + step
        better = rank[j] < best
        chosen[open_[better]] = j[better]
        best = np.where(better, rank[j], best)
        step += 1
        more = a[open_] + step < b[open_]
        open_, best = open_[more], best[more]
    return at, text, chosen, start, lo, hi


def _blocks(words: Words, size: int) -> tuple[np.ndarray, ...]:
    """Blocks of a piece: text, first window (in the text), number of windows, symbol key and key of the words (64 bits each)."""
    at, text, chosen, start, lo, hi = elect(words, size)
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (chosen[1:] < 0) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    at, text, chosen = at[first], text[first], chosen[first]
    low, high, place = at.copy(), at + size, np.zeros(len(at), np.int64)  # a window without a symbol stands for itself
    by = np.flatnonzero(chosen >= 0)
    low[by], high[by], place[by] = lo[chosen[by]], hi[chosen[by]], start[chosen[by]] - lo[chosen[by]] + 1
    symbol = mixed_bits(Ranges(words.first).of(low, high) + place.astype(np.uint64))
    whole = mixed_bits(Ranges(words.second).of(at, at + size - 1 + count) + (low - at).astype(np.uint64) * _P)
    return text, at - words.offsets[text], count, symbol, whole


def _settled(order: np.ndarray, *lead: np.ndarray) -> np.ndarray:
    """In sorted order: rows that follow one with equal leading keys."""
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in lead])
    return same


def _elected(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc, part, windows, whole, place): blocks by symbol; ``whole`` is the words' key.  A block that an earlier one of the
    piece equals is settled: it has a negative number of windows and a key of its own."""
    for batch in pieces(batches, "text", PIECE):
        words = Words(batch.column("text"))
        text, at, count, symbol, whole = _blocks(words, size)
        doc, part = (batch.column(c).to_numpy(zero_copy_only=False)[text].astype(np.int64) for c in ("doc", "part"))
        order = np.lexsort((at, part, doc, whole, symbol))
        later = _settled(order, symbol, whole)
        text, at, count, symbol, whole, doc, part = (x[order] for x in (text, at, count, symbol, whole, doc, part))
        symbol = np.where(later, mixed_bits(doc.astype(np.uint64)) >> np.uint64(40), symbol)
        yield pa.RecordBatch.from_arrays([pa.array(symbol.view(np.int64)), pa.array(doc), pa.array(part.astype(np.int32)), pa.array(np.where(later, -count, count).astype(np.int32)), pa.array(whole.view(np.int64)), pa.array(at.astype(np.int32))],
                                         ["key", "doc", "part", "windows", "whole", "place"])


def _lists(column: pa.Array, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat (row, place, windows, repeat) of the spots that belong to each row's part."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, flat = np.repeat(np.arange(len(sizes)), sizes), column.flatten()
    own, place, windows, repeat = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
    mine = own == part[row] if len(row) else np.zeros(0, bool)
    return row[mine], place[mine].astype(np.int64), windows[mine].astype(np.int64), repeat[mine].astype(bool)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``first``."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, doc, part, pos): the windows of open blocks under their words' names.  Windows that repeat an earlier one of the piece
    are settled: they carry a small key and ``-1 - pos``."""
    for batch in pieces(batches, "text", PIECE):
        part = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
        row, place, count, repeat = _lists(batch.column("spots"), part)
        row, place, count = row[~repeat], place[~repeat], count[~repeat]
        used = np.unique(row)
        if not len(used):
            continue
        words = Words(batch.column("text").take(pa.array(used)))
        text = np.repeat(np.searchsorted(used, row), count)
        pos = _spread(place, count)
        at = pos + words.offsets[text]
        k1, k2 = Ranges(words.first).of(at, at + size), Ranges(words.second).of(at, at + size)
        doc, part = batch.column("doc").to_numpy(zero_copy_only=False)[used[text]], part[used[text]]
        order = np.lexsort((pos, part, doc, k2, k1))
        later = _settled(order, k1, k2)
        k1, k2, doc, part, pos = (x[order] for x in (k1, k2, doc, part, pos))
        k1, k2 = np.where(later, mixed_bits(doc.astype(np.uint64)) >> np.uint64(40), k1), np.where(later, np.uint64(0), k2)
        cols = [k1.view(np.int64), k2.view(np.int64), doc, part.astype(np.int32), np.where(later, -1 - pos, pos).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["k1", "k2", "doc", "part", "pos"])


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Kept text, number of words and number removed, in place of the text and the repeats' places."""
    for batch in pieces(batches, "text", PIECE):
        words = Words(batch.column("text"))
        part = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
        depth = np.zeros(len(words.first) + 1, np.int64)
        for name in ("spots", "lost"):
            row, place, count, repeat = _lists(batch.column(name), part)
            at, count = (place + words.offsets[row])[repeat], count[repeat]
            np.add.at(depth, at, 1)
            np.add.at(depth, at + count - 1 + size, -1)
        gone = np.cumsum(depth[:-1]) > 0
        kept = np.concatenate(([0], np.cumsum(~gone)))[words.offsets]
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), words.flat.filter(pa.array(~gone))), " ")
        total = np.diff(words.offsets)
        names = [c for c in batch.schema.names if c.startswith("own_")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), text, pa.array(total), pa.array(total - np.diff(kept))], [*names, "kept", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, *, text: str = "text", size: int = SIZE, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add to each row ``kept`` (the words that no repeat covers, joined by a space), ``n_words`` and ``n_removed``.

    ``docs`` has ``doc_id``; a window of ``size`` words is a repeat if its words also start earlier (smaller id, or before in the document).
    """
    new = ["kept", "n_words", "n_removed"]
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    # rows without an id stand in the upper quarter of the numbers, spread by their text
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(body), 2))
    kept = [c for c in docs.columns if c.lower() not in {*new, *(d.lower() for d in drop)}]
    # every step below reads the same columns of this one exchange of the texts
    base = docs.select(*[col(c).alias(f"own_{k}") for k, c in enumerate(kept)], doc.alias("doc"), body.alias("text")).repartition("doc")
    base = base.withColumn("part", F.row_number().over(Window.partitionBy("doc").orderBy(F.xxhash64("text"))))
    blocks = base.mapInArrow(lambda it: _elected(it, size), "key long, doc long, part int, windows int, whole long, place int")
    group = Window.partitionBy("key").orderBy("whole", "doc", "part", "place")
    every = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = blocks.withColumns({"repeat": (F.col("windows") < 0) | (F.lag("whole").over(group) == F.col("whole")), "several": F.max("whole").over(every) != F.min("whole").over(every)})
    # settled blocks stand under small keys beside no other block that counts
    seen = seen.filter(F.col("repeat") | (F.col("several") & (F.col("windows") > 0)))
    one = lambda place, windows, repeat: F.struct("part", place.alias("place"), windows.alias("windows"), repeat.alias("repeat"))
    spots = seen.groupBy("doc").agg(F.collect_list(one(F.col("place"), F.abs("windows"), F.coalesce("repeat", F.lit(False)))).alias("spots"))
    open_ = base.join(spots, "doc").mapInArrow(lambda it: _windows(it, size), "k1 long, k2 long, doc long, part int, pos int")
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("doc", "part", "pos"))
    lost = open_.withColumn("nth", first).filter("pos < 0 OR nth > 1")
    lost = lost.groupBy("doc").agg(F.collect_list(one(F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos")), F.lit(1), F.lit(True))).alias("lost"))
    src = base.join(spots, "doc", "left").join(lost, "doc", "left")
    out = src.mapInArrow(lambda it: _cut(it, size), schema_with(src.select(*[f"own_{k}" for k in range(len(kept))]), kept="string", n_words="long", n_removed="long"))
    return out.select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(kept)], *new)


def digests(docs: DataFrame) -> DataFrame:
    """Words, removed words and digest of the kept words of every document."""
    return remove_repeats(docs.select("doc_id", "text"), drop=("text",)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in DuckDB's SQL.
DIGESTS_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(len(w) - {SIZE - 1})) AS s, unnest(list_transform(range(1, len(w) - {SIZE - 2}), lambda k: array_to_string(w[k:k + {SIZE - 1}], ' '))) AS g FROM d WHERE len(w) >= {SIZE}),
bad AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS nth FROM win) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, s + unnest(range({SIZE})) AS i FROM bad),
words AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
