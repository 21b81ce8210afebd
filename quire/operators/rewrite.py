"""Query expansion and spelling correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import vocab
from quire.functions.text import clean_query, words
from quire.session import top_k


def _table(d: dict[str, list[str]]) -> Column:
    """A small fixed vocabulary as a map literal."""
    return F.create_map(*[x for k, vs in d.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])


def _quoted(phrase: Column) -> Column:
    plain = F.replace(phrase, F.lit("-"), F.lit(" "))
    return F.when(F.contains(plain, F.lit(" ")), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(plain)


def expand_queries(queries: DataFrame, *, acronyms: dict[str, list[str]] | None = None,
                   synonyms: dict[str, list[str]] | None = None, per_word: int = 2) -> DataFrame:
    """Acronyms become OR groups, the first synonyms of a word are appended.

    Adds ``normalized``, ``acronyms``, ``synonyms`` and ``expanded``.  Once an acronym was
    expanded all terms are joined by OR, so expansion never narrows the result.  The
    original text stays in ``query`` for the vector side.
    """
    short, near = _table(acronyms or vocab.ACRONYMS), _table(synonyms or vocab.SYNONYMS)
    q = queries.withColumn("normalized", clean_query("query"))
    low = words(F.lower("normalized"))
    made = F.flatten(F.transform(F.filter(low, lambda w: F.map_contains_key(short, w)), lambda w: F.transform(
        F.try_element_at(short, w), lambda e: F.concat(F.upper(w), F.lit(" -> "), e))))
    group = lambda w: F.concat(F.lit("("), F.array_join(F.concat(F.array(F.upper(w)), F.transform(
        F.try_element_at(short, w), _quoted)), " OR "), F.lit(")"))
    terms = F.transform(low, lambda w: F.when(F.map_contains_key(short, w), group(w)).otherwise(w))
    q = q.withColumn("acronyms", made)
    joined = F.when(F.size("acronyms") > 0, F.array_join(terms, " OR ")).otherwise(F.array_join(terms, " "))
    extra = F.flatten(F.transform(F.filter(low, lambda w: F.map_contains_key(near, w)), lambda w: F.slice(
        F.try_element_at(near, w), 1, per_word)))
    q = q.withColumn("synonyms", extra)
    plain = F.when(F.size("acronyms") > 0, joined).otherwise(F.col("normalized"))
    return q.withColumn("expanded", F.concat_ws(" ", plain, F.nullif(F.array_join("synonyms", " "), F.lit(""))))


def term_groups(expanded: DataFrame, acronyms: dict[str, list[str]] | None = None) -> DataFrame:
    """R14 as rows: query_id and every alternative text its terms stand for."""
    short = _table(acronyms or vocab.ACRONYMS)
    low = words(F.lower("normalized"))
    alts = F.concat(low, F.flatten(F.transform(F.filter(low, lambda w: F.map_contains_key(short, w)),
                                               lambda w: F.try_element_at(short, w))), F.col("synonyms"))
    return expanded.select("query_id", F.explode(F.array_distinct(alts)).alias("alternative"))


def _deletions(word: Column) -> Column:
    """The word with none, one or two letters removed.

    Two words at most two edits apart share such a form, so the lookup is an equality join.
    """
    drop = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(
        F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = F.array_distinct(drop(word))
    twice = F.flatten(F.transform(once, drop))
    return F.array_distinct(F.concat(F.array(word), once, twice))


def correctable(word: Column) -> Column:
    """Words spelling correction may touch: no acronyms, digits, short or short mixed-case words."""
    low = F.lower(word)
    skip = ((word == F.upper(word)) & (low != F.upper(word))) | (F.length(word) <= 2) | low.isin(list(vocab.ACRONYMS))
    skip = skip | ((F.length(word) <= 4) & (word != low)) | word.rlike(r"\p{N}")
    return ~skip


def corrections(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Word and its correction, for every distinct unknown word of the queries.

    ``vocabulary`` holds term and df.  Nearest term first, then the most frequent.
    """
    w = queries.select(F.explode(words(clean_query("query"))).alias("raw"))
    w = w.filter(correctable(F.col("raw"))).select(F.lower("raw").alias("word")).distinct()
    unknown = w.join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti")
    left = unknown.select("word", F.explode(_deletions(F.col("word"))).alias("form"))
    known = vocabulary.filter(F.length("term") > 2).select("term", "df", F.explode(_deletions(F.col("term"))).alias("form"))
    pairs = left.join(known, "form").select("word", "term", "df").distinct()
    near = pairs.withColumn("edits", F.levenshtein("word", "term", 2)).filter("edits >= 0")
    return top_k(near, ["word"], [F.col("edits"), F.desc("df"), F.col("term")], 1)


def correct_queries(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Queries with unknown words replaced, and the list of replacements."""
    fixes = corrections(queries, vocabulary).select("word", F.col("term").alias("fix"))
    rows = queries.select("query_id", F.posexplode(words(clean_query("query"))).alias("pos", "raw"))
    rows = rows.withColumn("word", F.when(correctable(F.col("raw")), F.lower("raw"))).join(fixes, "word", "left")
    item = F.struct("pos", F.coalesce("fix", "raw").alias("out"),
                    F.when(F.col("fix").isNotNull(), F.concat("raw", F.lit(" -> "), "fix")).alias("note"))
    out = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return out.select("query_id", F.array_join(F.transform("items", lambda s: s["out"]), " ").alias("corrected"),
                      F.filter(F.transform("items", lambda s: s["note"]), lambda n: n.isNotNull()).alias("corrections"))
