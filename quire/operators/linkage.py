"""Entity resolution: duplicates, record linkage, import planning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quire.functions.similarity import block_ratio, common_enough, edits_within
from quire.functions.text import citation_key, doi_key, title_key, title_plain
from quire.session import checkpointed, repeat_per_salt, salt_of, spread, top_k


_RING = np.array([(1 << v) - 1 if v <= 8 else 255 & ~((1 << v - 8) - 1) for v in range(16)], np.uint8)
#: Texts up to this length carry marks of what stands before and after a gram; in longer ones they decide nothing.
LONG = 512


def _packed(counts: np.ndarray) -> list[np.ndarray]:
    """128 bits a row of which each inserted or deleted character changes one: sixteen counts of character classes on rings of eight bits."""
    return list(np.ascontiguousarray(_RING[counts & 15]).view(np.int64).reshape(-1, 2).T)


def _sites(texts: DataFrame, sizes: list[list[int]], pieces: bool) -> DataFrame:
    """Grams of texts (key, text, n, band, width): key, n, band, width, q, piece (a hash), at, and marks of the text before (l) and after (r) it.

    ``sizes`` gives the grams' lengths by the text's.  All grams, or with ``pieces`` those that lie side by side.  Of a gram that a text of more
    than ``LONG`` characters has more than once in a cell of ``width`` places the first stands for all, without marks.
    """
    own = ["key", "n", "band", "width"]
    marks = ["l0", "l1", "r0", "r1"]
    out = T.StructType([texts.schema[c] for c in own] + [T.StructField("q", T.IntegerType()), T.StructField("piece", T.LongType()), T.StructField("at", T.IntegerType())]
                       + [T.StructField(c, T.LongType()) for c in marks])
    names = out.fieldNames()

    def rows(batch: pa.RecordBatch, text: list[str], low: int) -> pa.RecordBatch:
        n = np.array([len(t) for t in text])
        code = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        start = np.cumsum(n) - n
        short = n.max() <= LONG
        if short:
            upto = np.zeros((len(code) + 1, 16), np.uint8)  # modulo 256, so differences are right modulo 16
            np.add.accumulate(np.eye(16, dtype=np.uint8)[(code & np.uint64(15)).astype(int)], axis=0, out=upto[1:])
        found, gram = [], code + np.uint64(1)
        kinds = [sizes[min(m, len(sizes) - 1)] for m in n]
        for q in range(1, 1 + max(map(max, kinds))):
            if q > 1:
                gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[q - 1:] + np.uint64(1)
            who = np.array([i for i, k in enumerate(kinds) if q in k and n[i] >= q], int)
            if not len(who):
                continue
            many = n[who] // q if pieces else n[who] - q + 1
            text_of = np.repeat(who, many)
            nth = np.arange(len(text_of)) - np.repeat(np.cumsum(many) - many, many)
            at = nth * q if pieces else nth
            place = start[text_of] + at
            piece = (gram[place] + np.uint64(q)) * np.uint64(0xC2B2AE3D27D4EB4F)
            piece = (piece ^ (piece >> np.uint64(29))).view(np.int64)
            if short:
                rest = upto[start[text_of] + n[text_of]] - upto[place + q]
                bits = _packed(upto[place] - upto[start[text_of]]) + _packed(rest)
            else:
                if not pieces:
                    width = batch.column("width").to_numpy()[low]
                    _, first = np.unique(np.stack((piece, at // width)), axis=1, return_index=True)
                    text_of, piece, at = text_of[first], piece[first], at[first]
                bits = [np.zeros(len(at), np.int64)] * 4
            found.append((text_of, np.full(len(at), q, np.int32), piece, at.astype(np.int32), *bits))
        of, *cols = map(np.concatenate, zip(*found))
        heads = [batch.column(c).take(pa.array(of + low)) for c in own]
        return pa.RecordBatch.from_arrays([*heads, *map(pa.array, cols)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, low = batch.column("text").to_pylist(), 0
            while low < len(texts):  # some 65,536 characters at once; a long text by itself
                high, size = low + 1, len(texts[low])
                while size <= LONG * 128 and high < len(texts) and len(texts[low]) <= LONG and len(texts[high]) <= LONG:
                    size, high = size + len(texts[high]), high + 1
                yield rows(batch, texts[low:high], low)
                low = high

    return texts.select("text", *own).mapInArrow(run, out)


def _edits(longer: Column, shorter: Column, t: float, measure: str) -> Column:
    """Most edits between two texts of these lengths at similarity ``t``; of the ratio, insertions and deletions only."""
    return F.floor((1 - t) * (longer if measure == "edits" else longer + shorter) + 1e-9).cast("int")


def _size(n: int, t: float, measure: str, beyond: bool = False) -> int:
    """Length of a longer text's grams: as many as its edits and one more lie side by side, five characters at most.

    ``beyond`` gives a size that holds for every greater length too.
    """
    edits = (1 - t) * n * (1 if measure == "edits" else 2) + 1e-9
    return max(1, min(5, int(n / ((edits if beyond else int(edits)) + 1))))


def _candidates(longer: DataFrame, shorter: DataFrame, t: float, measure: str, ties: Column) -> DataFrame:
    """Pairs (key_a, key_b) that may be similar, of a text and one not longer than it, or as long if ``ties`` holds.

    Each edit spoils one of the grams that lie side by side in the longer text, so among its rarest ones, one more than there
    may be edits, one stands in the shorter text, moved by as many places as there may be edits at most; what stands before it and
    what stands after it differ by no more than the edits together.
    """
    up = (2 - t) / t if measure == "ratio" else 1 / t
    sizes = [_size(n, t, measure) for n in range(399)] + [_size(399, t, measure, True)]
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(up) + 1e-9).cast("int") if up > 1 else F.col("n")
    # cells of places, as wide as a gram may move to both sides in the longest partners of a band
    width = 2 * F.floor((1 - t) * (1 if measure == "edits" else 2) * F.pow(F.lit(up), F.col("band") + 2)).cast("int") + 1
    rows = lambda df: spread(df, "key").withColumn("n", F.length("text")).withColumn("band", band).withColumn("width", width)
    # a partner may be longer by the factor ``up``: grams of every size that such a length takes
    reach = [sorted({sizes[min(m, 399)] for m in range(n, int(n * up + 1e-9) + 1)}) for n in range(400)]
    probe = _sites(rows(shorter), reach, False)
    index = _sites(rows(longer), [[q] for q in sizes], True)
    freq = probe.groupBy("piece").agg(F.count("*").alias("freq"))
    index = index.join(freq, "piece").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("freq", "piece", "at")))
    most = _edits(F.col("n"), F.col("n"), t, measure)
    index = index.filter(F.col("r") <= most + 1).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band")))).withColumn("width", width)
    index = index.withColumn("cell", F.explode(F.sequence(F.floor(F.greatest(F.col("at") - most, F.lit(0)) / F.col("width")), F.floor((F.col("at") + most) / F.col("width")))))
    name = lambda s: ["piece", "band", "cell", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "at", "l0", "l1", "r0", "r1"))]
    a, b = index.select(*name("a")), probe.withColumn("cell", F.floor(F.col("at") / F.col("width"))).select(*name("b"))
    edits = _edits(F.col("n_a"), F.col("n_b"), t, measure)
    bits = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    moved = F.abs(F.col("at_a") - F.col("at_b")), F.abs(F.col("n_a") - F.col("at_a") - F.col("n_b") + F.col("at_b"))
    apart = bits("l0") + bits("l1"), bits("r0") + bits("r1")
    if measure == "edits":  # a replaced character changes two counts and no length
        least = sum(F.greatest(d, F.ceil((x + d) / 2)) for x, d in zip(apart, moved))
    else:
        least = sum(F.greatest(d, x) for x, d in zip(apart, moved))
    may = ((F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & ties)) & (F.col("n_a") - F.col("n_b") <= edits)
    may &= (F.col("n_a") > LONG) | (least <= edits)
    return a.join(b, ["piece", "band", "cell"]).filter(may).select("key_a", "key_b").distinct()


def similar_texts(left: DataFrame, right: DataFrame | None, t: float, *, measure: str = "ratio",
                  strict: bool = False) -> DataFrame:
    """Pairs (key_a, key_b, similarity) of similar texts, lossless for both measures.

    Inputs hold distinct ``text`` with a ``key``; ``right`` None means a self join with
    key_a < key_b.  A candidate shares one of the longer text's rarest grams at a near place, in
    a neighbouring band of length, and the characters on either side of it differ in no more than the edits allow; all
    this is decided where the grams meet, so only few pairs are shuffled.  The longest common subsequence bounds both measures and
    decides which pairs are scored.
    """
    own = right is None
    if own:
        pairs = _candidates(left, left, t, measure, F.col("key_a") < F.col("key_b"))
        pairs = pairs.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
    else:
        pairs = _candidates(left, right, t, measure, F.lit(True))
        back = _candidates(right, left, t, measure, F.lit(False))
        pairs = pairs.unionByName(back.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))
    pairs = pairs.distinct()
    other = left if own else right
    pairs = pairs.join(left.select(F.col("key").alias("key_a"), F.col("text").alias("text_a")), "key_a")
    pairs = pairs.join(other.select(F.col("key").alias("key_b"), F.col("text").alias("text_b")), "key_b")
    # few bytes, much work: dealt over the cores whatever their size
    spark = pairs.sparkSession
    pairs = pairs.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "key_a", "key_b")
    both = F.length("text_a"), F.length("text_b")
    if measure == "ratio":
        need = F.ceil(t / 2 * (both[0] + both[1]) - 1e-9).cast("int")
        scored = pairs.filter(common_enough("text_a", "text_b", need)).withColumn("similarity", block_ratio("text_a", "text_b"))
    else:
        most = _edits(F.greatest(*both), F.least(*both), t, measure)
        scored = pairs.withColumn("similarity", 1 - edits_within("text_a", "text_b", most) / F.greatest(*both))
    return scored.filter(F.col("similarity") > t if strict else F.col("similarity") >= t).select("key_a", "key_b", "similarity")


def distinct_texts(df: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """Distinct non-empty texts, keyed by the smallest id that carries them."""
    return df.select(text.alias("text"), F.col(key).alias("key")).filter("text <> ''").groupBy("text").agg(F.min("key").alias("key"))


def duplicates_by_hash(docs: DataFrame, key: str = "id", hash_col: str = "hash") -> DataFrame:
    """Copies of the same content as (hash, copies, first_id).

    A report of groups: a group of any size stays one aggregate row.  Members are listed by
    :func:`copies`, one row each.
    """
    return docs.filter(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(
        F.count("*").alias("copies"), F.min(key).alias("first_id")).filter("copies > 1")


def copies(docs: DataFrame, key: str = "id", hash_col: str = "hash") -> DataFrame:
    """Every copy with the first id of its group (a star, never all pairs)."""
    groups = repeat_per_salt(duplicates_by_hash(docs, key, hash_col))
    rows = docs.select(key, hash_col).withColumn("salt", salt_of(key))
    return rows.join(groups, [hash_col, "salt"]).select(key, "first_id", "copies")


def duplicates_by_title(docs: DataFrame, t: float = 0.9, *, key: str = "id", title: str = "title",
                        measure: str = "ratio") -> DataFrame:
    """Duplicate records by title as pairs (id_a, id_b, similarity).

    Records with the same normal title are tied to the first of them; different titles are
    compared once per title.  The pairs span every duplicate group, without listing all
    pairs inside it.
    """
    norm = docs.select(F.col(key).alias("key"), F.trim(title_plain(title)).alias("text")).filter("text <> ''")
    titles = norm.groupBy("text").agg(F.min("key").alias("first"))
    spread = norm.withColumn("salt", salt_of("key"))
    same = spread.join(repeat_per_salt(titles), ["text", "salt"]).filter("key <> first").select(
        F.col("first").alias("id_a"), F.col("key").alias("id_b"), F.lit(1.0).alias("similarity"))
    near = similar_texts(titles.select("text", F.col("first").alias("key")), None, t, measure=measure)
    return same.unionByName(near.toDF("id_a", "id_b", "similarity"))


def duplicates_by_key(entries: DataFrame, key: str, norm: Column) -> DataFrame:
    """Entries sharing an identifier, each tied to the first one."""
    rows = entries.select(F.col(key).alias("key"), norm.alias("ident")).filter("ident IS NOT NULL")
    first = rows.groupBy("ident").agg(F.min("key").alias("first"))
    return rows.withColumn("salt", salt_of("key")).join(repeat_per_salt(first), ["ident", "salt"]).filter(
        "key <> first").select(F.col("first").alias("id_a"), F.col("key").alias("id_b"), F.col("ident"))


def _first_owner(library: DataFrame, norm: Column, name: str) -> DataFrame:
    return library.select(norm.alias(name), F.col("id")).filter(F.col(name).isNotNull()).groupBy(name).agg(
        F.min("id").alias("existing_id"))


def find_existing(incoming: DataFrame, library: DataFrame, *, t: float = 0.92, measure: str = "ratio") -> DataFrame:
    """First tier that finds each incoming record: DOI, arXiv id, then fuzzy title.

    Titles are compared on distinct normal forms; among similar ones the most recently
    added paper wins.
    """
    doi = _first_owner(library, doi_key("doi"), "k")
    arx = _first_owner(library, F.nullif(F.trim("arxiv_id"), F.lit("")), "k")
    by_doi = incoming.select("record_id", doi_key("doi").alias("k")).join(doi, "k").select(
        "record_id", F.lit(1).alias("tier"), F.lit("doi").alias("match_type"), "existing_id", F.lit(1.0).alias("similarity"))
    by_arx = incoming.select("record_id", F.trim("arxiv_id").alias("k")).join(arx, "k").select(
        "record_id", F.lit(2).alias("tier"), F.lit("arxiv_id").alias("match_type"), "existing_id", F.lit(1.0).alias("similarity"))
    sure = by_doi.unionByName(by_arx)
    rest = incoming.join(sure.select("record_id"), "record_id", "left_anti")
    norm = F.lower(F.trim("title"))
    mine, theirs = distinct_texts(rest, norm, "record_id"), distinct_texts(library, norm)
    near = similar_texts(mine, theirs, t, measure=measure, strict=True)
    newest = library.select(norm.alias("text"), F.struct("date_added", F.col("id")).alias("added")).filter("text <> ''")
    newest = newest.groupBy("text").agg(F.max("added").alias("added"))
    best = near.join(theirs.withColumnRenamed("key", "key_b"), "key_b").join(newest, "text")
    best = top_k(best, ["key_a"], [F.desc("added")], 1)
    owners = rest.select("record_id", norm.alias("text")).filter("text <> ''").join(
        mine.select("text", F.col("key").alias("key_a")), "text")
    by_title = owners.join(best.select("key_a", "added", "similarity"), "key_a").select(
        "record_id", F.lit(3).alias("tier"), F.lit("title_similarity").alias("match_type"),
        F.col("added.id").alias("existing_id"), F.round("similarity", 3).alias("similarity"))
    return top_k(sure.unionByName(by_title), ["record_id"], [F.col("tier")], 1)


def link_entries(entries: DataFrame, papers: DataFrame, *, t: float = 0.8, measure: str = "ratio") -> DataFrame:
    """Bibliography entries to papers by DOI, else by title.

    A title match must also contain the first 50 characters of the entry's title.
    """
    doi = _first_owner(papers, doi_key("doi"), "k")
    by_doi = entries.select("key", doi_key("doi").alias("k")).join(doi, "k").select(
        "key", F.col("existing_id").alias("paper_id"), F.lit("doi").alias("match_type"), F.lit(1.0).alias("confidence"))
    rest = entries.join(by_doi.select("key"), "key", "left_anti").filter(F.coalesce("title", F.lit("")) != "")
    mine = rest.select("key", F.lower("title").alias("raw"), title_plain("title").alias("text"))
    theirs = papers.select(F.col("id"), F.lower("title").alias("other"), title_plain("title").alias("text"))
    a = mine.groupBy("text").agg(F.min(F.xxhash64("text")).alias("key")).filter("text <> ''")
    b = distinct_texts(theirs, F.col("text"))
    near = similar_texts(a, b, t, measure=measure)
    near = near.join(a.select("text", F.col("key").alias("key_a")), "key_a").join(mine, "text").drop("text")
    near = near.join(b.select("text", F.col("key").alias("key_b")), "key_b").join(theirs, "text")
    near = near.filter(F.contains("other", F.substring("raw", 1, 50)))
    by_title = near.groupBy("key").agg(F.min(F.struct("id", "similarity")).alias("m")).select(
        "key", F.col("m.id").alias("paper_id"), F.lit("title").alias("match_type"), F.round("m.similarity", 3).alias("confidence"))
    found = by_doi.unionByName(by_title)
    return entries.select("key").join(found, "key", "left").withColumn("matched", F.col("paper_id").isNotNull())


def match_references(refs: DataFrame, papers: DataFrame, *, t: float = 0.85, k: int = 5, accept: float = 0.95,
                     measure: str = "ratio") -> DataFrame:
    """Parsed references to papers by DOI, else the best ``k`` by title; strong ones are accepted."""
    doi = _first_owner(papers, doi_key("doi"), "k")
    by_doi = refs.select("reference_id", doi_key("parsed_doi").alias("k")).join(doi, "k").select(
        "reference_id", F.col("existing_id").alias("paper_id"), F.lit("doi").alias("match_type"), F.lit(1.0).alias("confidence"))
    rest = refs.join(by_doi.select("reference_id"), "reference_id", "left_anti")
    mine, theirs = distinct_texts(rest, F.lower("parsed_title"), "reference_id"), distinct_texts(papers, F.lower("title"))
    near = top_k(similar_texts(mine, theirs, t, measure=measure, strict=True), ["key_a"],
                 [F.desc("similarity"), F.col("key_b")], k)
    owners = rest.select("reference_id", F.lower("parsed_title").alias("text")).join(
        mine.select("text", F.col("key").alias("key_a")), "text")
    # papers sharing a title: at most k of them can be among the best k
    holders = top_k(papers.select(F.lower("title").alias("text"), F.col("id").alias("paper_id")), ["text"], [F.col("paper_id")], k)
    holders = holders.join(theirs.select("text", F.col("key").alias("key_b")), "text").select("key_b", "paper_id")
    by_title = owners.join(near, "key_a").join(holders, "key_b").select(
        "reference_id", "paper_id", F.lit("title_similarity").alias("match_type"), F.round("similarity", 3).alias("confidence"))
    out = top_k(by_doi.unionByName(by_title), ["reference_id"], [F.desc("confidence"), F.col("paper_id")], k, "rank")
    return out.withColumn("match_status", F.when((F.col("rank") == 1) & (F.col("confidence") >= accept), "matched"))


def plan_import(attachments: DataFrame, papers: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """One action per attachment, equal to deciding them one after the other by ordinal.

    A file is taken when neither its parent nor its hash has been taken by an earlier
    ordinal.  Each round takes every attachment that comes first at both its parent and
    its hash, then drops what those rule out; the result is the sequential one.
    """
    owner = papers.select(F.col("zotero_key").alias("parent_key"), F.col("id").alias("paper_id"),
                          (F.coalesce(F.col("file_path"), F.lit("")) != "").alias("has_file"))
    rows = attachments.join(owner, "parent_key", "left").withColumn("has_file", F.coalesce("has_file", F.lit(False)))
    known = known_hashes.select("file_hash").distinct().withColumn("known", F.lit(True))
    rows = checkpointed(rows.join(known, "file_hash", "left").withColumn("known", F.coalesce("known", F.lit(False))))
    left = rows.filter("NOT has_file AND NOT known AND file_hash IS NOT NULL").select("ordinal", "parent_key", "file_hash")
    taken = left.limit(0)
    while True:
        first_p = left.groupBy("parent_key").agg(F.min("ordinal").alias("ordinal"))
        first_h = left.groupBy("file_hash").agg(F.min("ordinal").alias("ordinal"))
        # one row per parent and per hash, so both joins are on unique ordinals
        new = checkpointed(first_p.join(first_h, "ordinal"))
        if new.isEmpty():
            break
        taken = checkpointed(taken.unionByName(new))
        left = checkpointed(left.join(new.select("parent_key"), "parent_key", "left_anti").join(
            new.select("file_hash"), "file_hash", "left_anti"))
    by_parent = taken.select("parent_key", F.col("ordinal").alias("parent_taken"))
    by_hash = repeat_per_salt(taken.select("file_hash", F.col("ordinal").alias("hash_taken")))
    out = rows.withColumn("salt", salt_of("ordinal")).join(by_hash, ["file_hash", "salt"], "left").drop("salt")
    out = out.join(by_parent, "parent_key", "left")
    first = rows.filter("has_file").groupBy("parent_key").agg(F.min("ordinal").alias("first_seen"))
    out = out.join(first, "parent_key", "left")
    n = F.col("ordinal")
    action = (F.when(F.col("has_file") & (n == F.col("first_seen")), "skip_has_pdf")
              .when(F.col("has_file") | (F.col("parent_taken") < n), "skip_extra_pdf")
              .when(F.col("file_hash").isNull(), "skip_missing_file")
              .when(F.col("known") | (F.col("hash_taken") < n), "skip_duplicate_hash")
              .when(F.col("paper_id").isNotNull(), "attach").otherwise("new_import"))
    return out.select("ordinal", "parent_key", "paper_id", "file_hash", action.alias("action"))


def match_existing(items: DataFrame, papers: DataFrame) -> DataFrame:
    """Existing paper of each imported item, by DOI, else by exact title key."""
    doi = _first_owner(papers, doi_key("doi"), "_d").withColumnRenamed("existing_id", "by_doi")
    title = _first_owner(papers, title_key("title"), "_t").withColumnRenamed("existing_id", "by_title")
    out = items.withColumn("_d", doi_key("doi")).withColumn("_t", title_key("title"))
    out = out.join(doi, "_d", "left").join(title, "_t", "left")
    return out.withColumn("paper_id", F.coalesce("by_doi", "by_title")).drop("_d", "_t", "by_doi", "by_title")


def citation_keys(papers: DataFrame) -> DataFrame:
    """Key per paper and a letter suffix where several papers share it (a..z, then numbers)."""
    keyed = papers.select("id", citation_key("title", "authors", "year").alias("base_key"))
    # ranks are built from ranges of ids, so a key shared by much of the library is never sorted whole
    keyed = keyed.withColumn("range", F.floor(F.col("id") / 65536))
    sizes = keyed.groupBy("base_key", "range").agg(F.count("*").alias("size"))
    before = Window.partitionBy("base_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn(
        "holders", F.sum("size").over(Window.partitionBy("base_key")))
    place = F.row_number().over(Window.partitionBy("base_key", "range").orderBy("id"))
    keyed = keyed.withColumn("place", place).join(sizes, ["base_key", "range"]).withColumn("n", (F.col("before") + F.col("place")).cast("int"))
    letter = F.when(F.col("n") <= 26, F.char(F.lit(96) + F.col("n"))).otherwise(F.concat(F.lit("_"), F.col("n").cast("string")))
    key = F.when(F.col("holders") > 1, F.concat("base_key", letter)).otherwise(F.col("base_key"))
    return keyed.select("id", "base_key", "holders", key.alias("citation_key"))


def bib_updates(entries: DataFrame, papers: DataFrame) -> DataFrame:
    """Abstract and year the library can add to a bibliography entry with the same DOI."""
    lib = papers.select(doi_key("doi").alias("_d"), F.struct("id", "abstract", "year").alias("p")).filter("_d IS NOT NULL")
    lib = lib.groupBy("_d").agg(F.min("p").alias("p"))
    out = entries.withColumn("_d", doi_key(F.col("fields")["doi"])).join(lib, "_d")
    lacks = lambda f: F.coalesce(F.col("fields")[f], F.lit("")) == ""
    abstract = F.when(lacks("abstract") & (F.coalesce("p.abstract", F.lit("")) != ""),
                      F.concat(F.substring("p.abstract", 1, 200), F.lit("...")))
    year = F.when(lacks("year"), F.col("p.year").cast("string"))
    changes = F.map_filter(F.create_map(F.lit("abstract"), abstract, F.lit("year"), year), lambda k, v: v.isNotNull())
    return out.select("key", F.col("p.id").alias("paper_id"), changes.alias("changes")).filter(F.size("changes") > 0)


def cited_in_projects(papers: DataFrame, project_entries: DataFrame) -> DataFrame:
    """(paper, project) pairs where the project's bibliography holds the paper's DOI or normal title."""
    from quire.functions.text import title_ascii

    nonempty = lambda c: F.nullif(c, F.lit(""))
    side = lambda df, who, norm: df.select(F.col(who), norm.alias("k")).filter("k IS NOT NULL").distinct()
    tie = lambda norm_p, norm_e: side(papers, "id", norm_p).join(side(project_entries, "project", norm_e), "k").select("id", "project")
    doi = tie(doi_key("doi"), doi_key("doi"))
    title = tie(nonempty(title_ascii("title")), nonempty(title_ascii("title")))
    return doi.unionByName(title).distinct()
