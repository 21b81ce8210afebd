"""Operator 1: quality rules as a bitmask ledger, in DataFrame functions only.

Every measurement is taken once per document and every rule judged once; the ledger keeps both (``fail_mask`` has bit k set where
rule k fails).  Policies are versioned masks applied to the ledger afterwards, and ablations are bitwise aggregations of it: no
text is read again.

Repeated windows: each three-word window gets a hash shifted beside its position in one long, and the sorted longs show which
windows have equal hash parts; only those are compared as words.  The work per document is one sort of primitives.

Defined results: a null, empty or blank text has zero measurements and fails ``few_words``; ratios over nothing count as zero;
repeated rows each give a row; input columns named like a measurement are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.common import SPACE_CHARS, col, others, words_of

MEASURES = ["n_words", "n_chars_text", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words", "n_upper", "n_letters",
            "n_bullet_lines", "n_ellipsis_lines", "n_exclaims", "n_braces", "n_replaced"]

#: Rules in bit order: name and condition of failing, on the measurements.  Ratios are whole-number comparisons.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_words", "n_words > 1000000"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
    ("few_letter_words", "10 * n_alpha_words < 8 * n_words"),
    ("capitals", "10 * n_upper > 5 * n_letters"),
    ("exclamations", "10 * n_exclaims > 3 * n_words"),
    ("braces", "10 * n_braces > n_words"),
    ("replacement_characters", "100 * n_replaced > n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")

#: Policies by version: the rules that decide.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "web-1": tuple(n for n, _ in RULES if n != "many_words"),
}


def policy_mask(names: tuple[str, ...]) -> int:
    return reduce(lambda m, n: m | BIT[n], names, 0)


def _repeated_windows(df: DataFrame) -> DataFrame:
    """``n_repeat_words`` from ``__w`` (words): positions covered by three-word windows that the text holds at least twice."""
    w, n, b = F.col("__w"), F.size("__w"), F.col("__b")
    df = df.withColumn("__b", F.length(F.bin(n)))
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: _pack(w, b, i))
    df = df.withColumn("__s", F.sort_array(F.when(n >= 3, packed).otherwise(F.array().cast("array<bigint>"))))
    s = F.col("__s")
    same = lambda x, y: F.call_function("shiftright", x, b) == F.call_function("shiftright", y, b)
    some = F.when(F.size(s) > 0, F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))).otherwise(s)
    df = df.withColumn("__c", some)
    place = lambda x: (x - F.call_function("shiftleft", F.call_function("shiftright", x, b), b)).cast("int")
    named = F.transform("__c", lambda x: F.struct(F.concat_ws(" ", F.get(w, place(x)), F.get(w, place(x) + 1), F.get(w, place(x) + 2)).alias("g"), place(x).alias("i")))
    df = df.withColumn("__e", F.sort_array(named))
    e = F.col("__e")
    twice = F.when(F.size(e) > 0, F.filter(e, lambda x, i: (x["g"] == F.get(e, i - 1)["g"]) | (x["g"] == F.get(e, i + 1)["g"]))).otherwise(e)
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", covered).drop("__b", "__s", "__c", "__e")


def _pack(w: Column, b: Column, i: Column) -> Column:
    return F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), b).bitwiseOR(i.cast("long"))


def measure(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """All measurements, once per row."""
    df = docs.select(*others(docs, [*MEASURES, "fail_mask", "__t", "__w", "__l"], drop), F.coalesce(col(text).cast("string"), F.lit("")).alias("__t"))
    t = F.col("__t")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    df = df.withColumns({"__w": words_of(t), "__l": lines})
    df = df.withColumns({
        "n_words": F.size("__w").cast("long"),
        "n_chars_text": F.length(t).cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_alpha_words": count(r"[^\x20\x09-\x0D\p{L}]*\p{L}[^\x20\x09-\x0D]*"),
        "n_upper": count(r"\p{Lu}"),
        "n_letters": count(r"\p{L}"),
        "n_bullet_lines": count(r"(?m)^[ \t]*[-*•‣●]"),
        "n_ellipsis_lines": count(r"(?m)(\.\.\.|…)[ \t]*$"),
        "n_exclaims": count("!"),
        "n_braces": count(r"[{}]"),
        "n_replaced": count("�"),
    })
    return _repeated_windows(df.drop("__l")).drop("__t", "__w")


def ledger(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and ``fail_mask`` of every row."""
    mask = reduce(lambda a, x: a.bitwiseOR(x), [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)])
    return measure(docs, text, drop).withColumn("fail_mask", mask)


def apply_policy(ledger: DataFrame, version: str) -> DataFrame:
    """Add ``policy`` and ``kept``: no rule of the policy fails."""
    mask = policy_mask(POLICIES[version])
    return ledger.withColumns({"policy": F.lit(version), "kept": F.col("fail_mask").bitwiseAND(F.lit(mask)) == 0})


def ablations(ledger: DataFrame, version: str) -> DataFrame:
    """What each rule of a policy does: rows that fail it, that fail only it (kept again without it), and the words of both.

    The ledger is first summed by mask (at most two to the number of rules, partial sums per task); no row is read twice.
    """
    mask = policy_mask(POLICIES[version])
    by_mask = ledger.groupBy(F.col("fail_mask").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("rows"), F.sum("n_words").alias("words"))
    bits = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in POLICIES[version]]))
    each = by_mask.withColumn("r", bits).select("m", "rows", "words", "r.*")
    hit, alone = F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("m") == F.col("bit")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    return each.groupBy("rule", "bit").agg(total("rows", hit).alias("failed"), total("rows", alone).alias("only_this"), total("words", hit).alias("failed_words"),
                                           total("words", alone).alias("only_this_words"), total("rows", F.col("m") == 0).alias("kept"))


def decisions(docs: DataFrame) -> DataFrame:
    """Ledger and verdict of every document under the base rules and the web policy."""
    led = apply_policy(ledger(docs.select("doc_id", "text"), drop=("text",)), "web-1")
    return led.withColumn("base_failed", F.col("fail_mask").bitwiseAND(F.lit(policy_mask(BASE))) != 0)


#: The same in DuckDB's SQL.
DECISIONS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, unnest(range(len(ws) - 2)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) AS g FROM w WHERE len(ws) >= 3),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, sum(least(3, gap)) AS n FROM (SELECT rid, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -3) AS gap FROM dup) GROUP BY rid),
cnt AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(t) AS BIGINT) AS n_chars_text, CAST(length(list_aggregate(list_concat(ws, ['']), 'string_agg', '')) AS BIGINT) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(CAST(cov.n AS BIGINT), 0) AS n_repeat_words,
  len(regexp_extract_all(t, '[^\x20\x09-\x0D\p{L}]*\p{L}[^\x20\x09-\x0D]*')) AS n_alpha_words, len(regexp_extract_all(t, '\p{Lu}')) AS n_upper, len(regexp_extract_all(t, '\p{L}')) AS n_letters,
  len(regexp_extract_all(t, '(?m)^[ \t]*[-*•‣●]')) AS n_bullet_lines, len(regexp_extract_all(t, '(?m)(\.\.\.|…)[ \t]*$')) AS n_ellipsis_lines, len(regexp_extract_all(t, '!')) AS n_exclaims,
  len(regexp_extract_all(t, '[{}]')) AS n_braces, len(regexp_extract_all(t, chr(65533))) AS n_replaced
  FROM w LEFT JOIN cov USING (rid)),
m AS (SELECT *, """ + " | ".join(f"(CASE WHEN {rule} THEN {1 << k} ELSE 0 END)" for k, (_, rule) in enumerate(RULES)) + f""" AS fm FROM cnt)
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in MEASURES)}, CAST(fm AS BIGINT) AS fail_mask, 'web-1' AS policy, (fm & {policy_mask(POLICIES["web-1"])}) = 0 AS kept,
  (fm & {policy_mask(BASE)}) <> 0 AS base_failed FROM m"""
