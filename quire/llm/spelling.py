"""Operator 11: grouping of spelling variants, words one edit apart, by pivotal grams.

The bigrams of a word are put in one order for all words, rarest first.  The first three of them (and those that tie with the last) are its
prefix; of these, two disjoint ones with the fewest words between them, found by dynamic programming, are its pivots.  An edit touches
one of two disjoint grams at most, so of two near words the one whose prefix ends earlier in the order has a pivot left in the other's
prefix: pivots of all words are looked up among the prefixes of all words.

A gram that is left limits places: the edit is either after it, and then the words agree up to its end, or before it, and then they agree from
its beginning, with the place shifted by the difference of the lengths.  On the side of the edit, cut in half at a place that the length fixes,
one half is untouched.  Length, place, the agreeing part and the untouched half are the join key; the edit distance is verified in the
join itself, so no candidate pair leaves it.

Words are counted with partial sums before the shuffle.  The table of gram frequencies has at most 90 * 90 rows in this alphabet.

Defined results: a null, empty or letterless text has no words; a null ``doc_id`` counts as an empty one in the hash; repeated rows count again;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import LOWER, UPPER, col
from quire.llm.resample import crc32_sql
from quire.session import checkpointed

#: Letters of a word, grams, and the edited share of the words.
LETTERS = r"[A-Za-zÀ-ÿ]"
Q, LEAST_CHARS, LEAST_COUNT, TIMES, EVERY = 2, 7, 2, 10, 31


def counted(docs: DataFrame, *, text: str = "text", key: str = "doc_id", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int | None = EVERY) -> DataFrame:
    """Words (word, n) of at least ``least_chars`` letters and ``least_count`` occurrences.

    With ``every``, a letter of one in so many words is left out, chosen by the CRC of id and word.
    """
    low = F.translate(col(text).cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS + f"{{{least_chars},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if every:
        h = F.crc32(F.concat("id", F.lit(":"), "run"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def pivots_of(places: list[int], costs: list[int], picks: int, q: int = Q) -> list[int]:
    """Numbers of ``picks`` disjoint grams (``places`` ascending) of least total cost: dynamic programming over grams and picks."""
    n = len(places)
    best = [[(0, ())] * (n + 1)] + [[(float("inf"), ())] * (n + 1) for _ in range(picks)]
    for k in range(1, picks + 1):
        for i in range(1, n + 1):
            j = i - 1  # grams that end before this one begins
            while j and places[j - 1] > places[i - 1] - q:
                j -= 1
            cost, chosen = best[k - 1][j]
            best[k][i] = min(best[k][i - 1], (cost + costs[i - 1], (*chosen, i - 1)))
    return list(best[picks][n][1])


def prefix_of(word: str, frequency: dict[str, int]) -> list[tuple[int, bool]]:
    """Places of the prefix grams of a word, and whether each is a pivot."""
    found = [(frequency[word[i:i + Q]], word[i:i + Q], i) for i in range(len(word) - Q + 1)]
    last = sorted(found)[Q][:2]
    inside = [x for x in found if x[:2] <= last]
    chosen = set(pivots_of([x[2] for x in inside], [x[0] for x in inside], 2))
    return [(i, k in chosen) for k, (_, _, i) in enumerate(inside)]


def _text(start: Column, end: Column | None = None) -> Column:
    """Part of the word from ``start`` (from 0) to before ``end``."""
    return F.substring("word", start + 1, (F.length("word") if end is None else end) - start)


def _key(side: int, length: Column, place: Column, *parts: Column) -> Column:
    return F.xxhash64(F.lit(side), length, place, *parts)


def _index_keys(place: Column) -> Column:
    """Keys of a prefix gram: edit after it, in the second or in the first half of the rest; edit before it, likewise."""
    length, none = F.length("word"), F.lit("")
    half, before = place + Q + F.floor((length - place - Q) / 2).cast("int"), F.floor(place / 2).cast("int")
    return F.array(_key(0, length, place, _text(F.lit(0), half), none), _key(1, length, place, _text(F.lit(0), place + Q), _text(half)),
                   _key(2, length, place, none, _text(before)), _key(3, length, place, _text(F.lit(0), before), _text(place)))


def _lookup_keys(place: Column, e: Column) -> Column:
    """Keys under which a word that is ``e`` letters longer than this one is found by a pivot; null where the case can't be."""
    own, length, none, zero = F.length("word"), F.length("word") + e, F.lit(""), F.lit(0)
    rest = length - place - Q
    front = F.floor(rest / 2).cast("int")
    half, back = place + Q + front, own - (rest - front)
    at = place + e
    before = F.floor(at / 2).cast("int")
    after, ahead = (rest >= 0) & (F.greatest(rest, own - place - Q) > 0), (at >= 0) & (F.greatest(at, place) > 0)
    return F.array(F.when(after & (own >= half), _key(0, length, place, _text(zero, half), none)),
                   F.when(after & (back >= place + Q), _key(1, length, place, _text(zero, place + Q), _text(back))),
                   F.when(ahead & (before - e).between(0, place), _key(2, length, at, none, _text(before - e))),
                   F.when(ahead & (before <= place), _key(3, length, at, _text(zero, before), _text(place))))


def near(words: DataFrame, *, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Pairs (word, n, other, other_n) of words one edit apart, in both directions and once each."""
    if least_chars < 2 * Q:
        raise ValueError("words must be long enough for two disjoint grams")
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - (Q - 1)), lambda i: F.substring("word", i, F.lit(Q))))
    frequency = {r["gram"]: r["f"] for r in words.select(gram.alias("gram")).groupBy("gram").agg(F.count("*").alias("f")).collect()}  # bounded by the alphabet
    shared = words.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *x) for k, w in enumerate(batch.column("word").to_pylist()) for x in prefix_of(w, shared.value)]
            at, places, pivot = (list(x) for x in zip(*rows)) if rows else ([], [], [])
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("word").take(at), batch.column("n").take(at), pa.array(places, pa.int32()), pa.array(pivot, pa.bool_())], ["word", "n", "place", "pivot"])

    index = words.select("word", "n").mapInArrow(run, "word string, n long, place int, pivot boolean")
    asking = index.filter("pivot").withColumn("e", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).select(F.col("word").alias("a"), F.col("n").alias("an"), F.explode(F.array_compact(_lookup_keys(F.col("place"), F.col("e")))).alias("key"))
    asked = index.select(F.col("word").alias("b"), F.col("n").alias("bn"), F.explode(_index_keys(F.col("place"))).alias("key"))
    met = asking.join(asked, (asking["key"] == asked["key"]) & (F.levenshtein("a", "b", 1) == 1))
    one, two = F.struct(F.col("a").alias("w"), F.col("an").alias("n")), F.struct(F.col("b").alias("w"), F.col("bn").alias("n"))
    pairs = met.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct()
    both = F.explode(F.array(F.struct(F.col("x").alias("p"), F.col("y").alias("o")), F.struct(F.col("y").alias("p"), F.col("x").alias("o"))))
    return pairs.select(both.alias("s")).select(F.col("s.p.w").alias("word"), F.col("s.p.n").alias("n"), F.col("s.o.w").alias("other"), F.col("s.o.n").alias("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """Last word of every chain (word, form): each round doubles the reach.  A form is far more frequent than its word, so chains are short and end."""
    up = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        far = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = checkpointed(up.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        up = step.select("word", "root")


def variants(docs: DataFrame, *, text: str = "text", times: int = TIMES, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int | None = None) -> DataFrame:
    """Per word: ``form``, its most frequent near word if that is at least ``times`` as frequent; ``root``, where forms lead; ``n``, ``n_near`` and ``form_n``."""
    words = checkpointed(counted(docs, text=text, least_chars=least_chars, least_count=least_count, every=every))
    best = F.min(F.struct((-F.col("other_n")).alias("by"), F.col("other").alias("w")))
    found = near(words, least_chars=least_chars).groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.by") >= times * F.col("n")
    found = checkpointed(found.select("word", "n_near", F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.by")).alias("form_n")))
    last = roots(found.filter("form IS NOT NULL"))
    return (words.join(found, "word", "left").join(last, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def grouped(docs: DataFrame) -> DataFrame:
    """Variants among the words of all documents, with a letter left out of one in 31."""
    return variants(docs, every=EVERY)


#: The same in DuckDB's SQL: near words are equal without one letter at the same place, or one is the other without a letter.
GROUPED_SQL = rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]{{{LEAST_CHARS},}}')) AS run FROM documents),
p AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {crc32_sql("(doc_id || ':' || run)")} AS h FROM p),
e AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS BIGINT) AS i FROM w)),
m AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
      UNION SELECT v.word, v.n, w.word, w.n FROM v JOIN w ON v.cut = w.word UNION SELECT w.word, w.n, v.word, v.n FROM v JOIN w ON v.cut = w.word),
f AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS best, max(other_n) AS best_n, any_value(n) AS n FROM m GROUP BY word),
g AS (SELECT word, n_near, CASE WHEN best_n >= {TIMES} * n THEN best END AS form, CASE WHEN best_n >= {TIMES} * n THEN best_n END AS form_n FROM f),
up AS (SELECT word, form AS top, 1 AS depth FROM g WHERE form IS NOT NULL UNION ALL SELECT up.word, g.form, depth + 1 FROM up JOIN g ON g.word = up.top WHERE g.form IS NOT NULL),
z AS (SELECT word, arg_max(top, depth) AS root FROM up GROUP BY word)
SELECT w.word, g.form, coalesce(z.root, w.word) AS root, w.n, coalesce(g.n_near, 0) AS n_near, g.form_n FROM w LEFT JOIN g ON g.word = w.word LEFT JOIN z ON z.word = w.word"""
