"""Operator 9: license scans with ordered signature rules, in DataFrame functions only.

A text passes a keyword prefilter (plain substring tests); only then are its words built.  A rule is tied to one keyword and has a
pattern for the words before it and one for the words after it, so each rule looks only at the neighbourhood of its keyword's
places, and a match is an interval of words.  Rules are ordered by level: a detection whose interval lies in one of the same or a
stronger level (of equal intervals, in the first by level and rule) is suppressed.

Words are runs of letters and digits after A-Z are lower-cased; characters beyond ASCII count as letters.

Defined results: a null or empty text has no words, null places, empty labels and score 0; repeated rows each give a row; a text
full of licenses gives all its places (no limit), only the words around a place travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.llm.common import LOWER, UPPER, col, others

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words kept on each side of a keyword; no pattern is longer.
REACH = 12

# Phrases that must be found, with their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Hand-written families: label, titles (patterns of the words before "license"), short names, versions.
FAMILIES: list[tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = [
    ("gpl", ("(gnu )?general public", "gnu gpl", "gpl"), ("gpl",), ("1.0", "2.0", "3.0")),
    ("lgpl", ("(gnu )?(lesser|library) general public", "gnu lgpl", "lgpl"), ("lgpl",), ("2.0", "2.1", "3.0")),
    ("agpl", ("(gnu )?affero general public", "gnu agpl", "agpl"), ("agpl",), ("1.0", "3.0")),
    ("gfdl", ("(gnu )?free documentation", "gfdl"), ("gfdl",), ("1.1", "1.2", "1.3")),
    ("apache", ("apache( software)?", "asl"), ("asl",), ("1.0", "1.1", "2.0")),
    ("mpl", ("mozilla public", "mpl"), ("mpl",), ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public", "epl"), ("epl",), ("1.0", "2.0")),
    ("cddl", ("common development and distribution", "cddl"), ("cddl",), ("1.0", "1.1")),
    ("cpl", ("common public",), ("cpl",), ("1.0",)),
    ("eupl", ("european union public", "eupl"), ("eupl",), ("1.0", "1.1", "1.2")),
    ("osl", ("open software",), (), ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("afl", ("academic free",), (), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", ("(perl )?artistic",), (), ("1.0", "2.0")),
    ("lppl", ("latex project public", "lppl"), ("lppl",), ("1.0", "1.1", "1.2", "1.3")),
    ("php", ("php",), (), ("3.0", "3.01")),
    ("python", ("python( software foundation)?",), (), ("2.0",)),
    ("zpl", ("zope public", "zpl"), ("zpl",), ("1.1", "2.0", "2.1")),
    ("bsl", ("boost software",), (), ("1.0",)),
    ("busl", ("business source",), ("busl",), ("1.1",)),
    ("sspl", ("server side public", "sspl"), ("sspl",), ("1.0",)),
    ("elastic", ("elastic",), (), ("2.0",)),
    ("ofl", ("(sil )?open font",), (), ("1.0", "1.1")),
    ("odbl", ("open database", "odbl"), ("odbl",), ("1.0",)),
    ("odc-by", ("open data commons attribution",), (), ("1.0",)),
    ("pddl", ("public domain dedication and",), ("pddl",), ("1.0",)),
    ("cecill", ("cecill",), ("cecill",), ("1.0", "2.0", "2.1")),
    ("mulan", ("mulan permissive software", "mulan psl"), (), ("1.0", "2.0")),
    ("ecl", ("educational community",), (), ("1.0", "2.0")),
    ("npl", ("netscape public",), (), ("1.0", "1.1")),
    ("apsl", ("apple public source",), ("apsl",), ("1.0", "1.1", "1.2", "2.0")),
    ("rpl", ("reciprocal public",), (), ("1.1", "1.5")),
    ("cpal", ("common public attribution",), ("cpal",), ("1.0",)),
    ("upl", ("universal permissive",), (), ("1.0",)),
    ("mit", ("mit", "expat", "x11"), (), ()),
    ("bsd", ("(original |new |modified |simplified |revised )?bsd",), (), ()),
    ("isc", ("isc",), (), ()),
    ("zlib", ("zlib( libpng)?",), (), ()),
    ("ms-pl", ("microsoft public",), (), ()),
    ("ms-rl", ("microsoft reciprocal",), (), ()),
    ("ncsa", ("(university of illinois )?ncsa( open source)?",), (), ()),
    ("postgresql", ("postgresql",), (), ()),
    ("ruby", ("ruby",), (), ()),
    ("sleepycat", ("sleepycat",), (), ()),
    ("vim", ("vim",), (), ()),
    ("w3c", ("w3c( software)?( notice and)?",), (), ()),
    ("qpl", ("q public",), (), ()),
    ("proprietary", ("proprietary", "commercial", "end user"), (), ()),
]
CC_KINDS = {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderiv(ative)?s", "by-nc": "attribution noncommercial",
            "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderiv(ative)?s"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
BSD_CLAUSES = {"0": "(0|zero)", "1": "(1|one)", "2": "(2|two)", "3": "(3|three)", "4": "(4|four)"}
# Sentences of license texts: label, keyword, words before, words after.
SENTENCES = [
    ("mit", "granted", "permission is hereby", "free of charge to any person"),
    ("isc", "granted", "distribute this software for any purpose with or without fee is hereby", ""),
    ("bsd", "redistribution", "", "and use in source and binary forms"),
    ("bsd", "redistributions", "", "of source code must retain the above copyright"),
    ("zlib", "misrepresented", "the origin of this software must not be", ""),
    ("boost", "granted", "permission is hereby", "free of charge to any person or organization"),
    ("unlicense", "unencumbered", "this is free and", "software released into the public domain"),
    ("wtfpl", "wtfpl", "", ""),
    ("unlicense", "unlicense", "(the )?", ""),
    ("cc0-1.0", "cc0", "", "( ?1 0)?"),
    ("cc0-1.0", "creative", "", "commons zero"),
    ("public-domain", "dedicated", "", "to the public domain"),
    ("warranty-disclaimer", "warranties", "without", "or conditions of any kind"),
    ("warranty-disclaimer", "warranty", "without", "of any kind"),
]
LICENSE_WORDS = ("license", "licence")


def _version(v: str) -> str:
    """Pattern of a version's words: a final zero may be missing."""
    major, minor = v.split(".")
    return f"{major}( {minor})?" if minor == "0" else f"{major} {minor}"


def rules() -> list[tuple[int, str, int, float, str, str, str]]:
    """Signature rules in order: number, label, level, confidence, keyword, pattern before, pattern after.

    Levels: 1 identifiers, 2 names with version and later clause, 3 names with version, 4 sentences, 5 bare names.
    """
    out: list[tuple[str, int, float, str, str, str]] = []
    named: dict[str, str] = {}
    before = lambda p: f"(^| ){p}$" if p else "$"
    after = lambda p: f"^{p}( |$)" if p else "^"
    lead = "(v ?|version )?"
    for label, titles, shorts, versions in FAMILIES:
        for v in versions:
            full, number = f"{label}-{v}", _version(v)
            named[full] = f"{label.replace('-', ' ')} {v.replace('.', ' ')}"
            for keyword in LICENSE_WORDS:
                out += [(full, 3, 0.95, keyword, before(t), after(lead + number)) for t in titles]
            if label in ("gpl", "lgpl", "agpl", "gfdl"):
                later = f"{lead}{number} (of the license )?or (at your option )?(any )?later( version)?"
                out += [(f"{full}-or-later", 2, 0.97, "license", before(t), after(later)) for t in titles[:1]]
                out += [(f"{full}-or-later", 2, 0.97, s, before(""), after(later)) for s in shorts]
                named[f"{full}-or-later"] = f"{named[full]} or later"
            for s in shorts:
                out.append((full, 3, 0.9, s, before(""), after(lead + number)))
                out.append((full, 3, 0.9, f"{s}v{v.split('.')[0]}", before(""), after("" if v.endswith(".0") else v.split(".")[1])))
        for keyword in LICENSE_WORDS:
            out += [(label, 5, 0.8, keyword, before(t), after("")) for t in titles]
        if not versions:
            named[label] = label.replace("-", " ")
    for kind, title in CC_KINDS.items():
        short = kind.replace("-", " ")
        for v in CC_VERSIONS:
            full = f"cc-{kind}-{v}"
            named[full] = f"cc {short} {v.replace('.', ' ')}"
            out.append((full, 3, 0.95, "cc", before(""), after(f"{short} {_version(v)}")))
            out.append((full, 3, 0.95, "creative", before(""), after(f"commons {title} {_version(v)}")))
        out.append((f"cc-{kind}", 5, 0.8, "cc", before(""), after(short)))
        out.append((f"cc-{kind}", 5, 0.8, "creative", before(""), after(f"commons {title}")))
    for n, p in BSD_CLAUSES.items():
        full = f"bsd-{n}-clause"
        named[full] = f"bsd {n} clause"
        out.append((full, 3, 0.95, "bsd", before(f"{p} clause"), after("")))
        out.append((full, 3, 0.95, "bsd", before(""), after(f"{p} clause")))
    out += [(label, 4, 0.85, keyword, before(b), after(a)) for label, keyword, b, a in SENTENCES]
    out += [(label, 1, 1.0, "identifier", before("spdx license"), after(words)) for label, words in sorted(named.items())]
    out = sorted(dict.fromkeys(out), key=lambda r: r[1])  # stable: within a level as written
    return [(k, *r) for k, r in enumerate(out)]


#: Substrings of the prefilter: each keyword but "cc" holds one; that is looked for beside "by".
STEMS = ("licen", "gpl", "bsd", "gfdl", "cc0", "creative", "identifier", "granted", "redistribution", "misrepresented", "unencumbered", "wtfpl",
         "dedicated", "warrant", "asl", "mpl", "epl", "cddl", "cpl", "eupl", "lppl", "zpl", "busl", "sspl", "odbl", "pddl", "cecill", "apsl", "cpal")


def _words_in(match: Column) -> Column:
    """Number of words of a matched part."""
    bare = F.trim(match)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, " ")))


def _base(w: Column, a: Column) -> Column:
    """Base label of a keyword's place, or null."""
    at = lambda k: F.get(w, a["at"] - k)
    one, two = BASE[:2], BASE[2]
    hit = F.when((a["kw"] == "license") & (at(1) == one[0][0].split()[0]), F.lit(one[0][1])).when((a["kw"] == "license") & (at(1) == one[1][0].split()[0]), F.lit(one[1][1]))
    return hit.when((a["kw"] == "license") & (at(1) == two[0].split()[1]) & (at(2) == two[0].split()[0]), F.lit(two[1]))


def scan(docs: DataFrame, *, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Detections: each row once (with nulls) or once per unsuppressed detection, with the word interval ``[start, end)``.

    Adds ``row`` (number of the row), ``n_words``, ``places`` (base places: start and label), ``rule``, ``label``, ``level``,
    ``confidence``, ``start`` and ``end``.
    """
    new = ["row", "n_words", "places", "rule", "label", "level", "confidence", "start", "end"]
    table = rules()
    words = sorted({r[4] for r in table})
    df = docs.select(*others(docs, [*new, "__t", "__low", "__w", "__a"], drop), F.coalesce(col(text).cast("string"), F.lit("")).alias("__t"))
    df = df.withColumns({"row": F.monotonically_increasing_id(), "n_words": F.regexp_count("__t", F.lit(WORD)).cast("long"), "__low": F.lower("__t")})
    gate = F.rlike("__low", F.lit(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"))
    for stem in STEMS:
        gate = gate | F.contains("__low", F.lit(stem))
    kept = [c for c in df.columns if c not in ("__t", "__low")]
    df = df.select(*map(col, kept), F.when(gate, F.regexp_extract_all(F.translate("__t", UPPER, LOWER), F.lit(WORD), F.lit(0))).alias("__w"))
    w = F.col("__w")
    found = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("kw"), i.alias("at"))), lambda a: a["kw"].isin(words))
    df = df.withColumn("__a", found)
    near = lambda a: F.struct(a["kw"].alias("kw"), a["at"].alias("at"),
                              F.array_join(F.slice(w, F.greatest(F.lit(1), a["at"] - REACH + 1), F.least(F.lit(REACH), a["at"])), " ").alias("left"),
                              F.array_join(F.slice(w, a["at"] + 2, F.lit(REACH)), " ").alias("right"))
    starts = F.transform("__a", lambda a: F.struct((a["at"] - F.when(_base(w, a) == "gpl", 2).otherwise(1)).cast("long").alias("start"), _base(w, a).alias("label")))
    df = df.select(*map(col, kept), F.coalesce(F.filter(starts, lambda p: p["label"].isNotNull()), F.array().cast("array<struct<start:bigint,label:string>>")).alias("places"),
                   F.explode_outer(F.transform("__a", near)).alias("__a"))
    fixed = docs.sparkSession.createDataFrame(table, "rule int, label string, level int, confidence double, kw string, before string, after string")
    hit = (F.col("__a.kw") == F.col("kw")) & F.rlike(F.col("__a.left"), F.col("before")) & F.rlike(F.col("__a.right"), F.col("after"))
    df = df.join(F.broadcast(fixed), hit, "left")  # a fixed number of rows
    at = F.col("__a.at")
    df = df.withColumns({"start": (at - _words_in(F.call_function("regexp_extract", F.col("__a.left"), F.col("before"), F.lit(0)))).cast("long"),
                         "end": (at + 1 + _words_in(F.call_function("regexp_extract", F.col("__a.right"), F.col("after"), F.lit(0)))).cast("long")}).drop("__a", "kw", "before", "after")
    # rows of a text by start, longest first: what contains a row precedes it
    order = Window.partitionBy("row").orderBy(F.col("start").asc_nulls_last(), F.col("end").desc(), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(*[F.when(F.col("level") == k, F.max(F.when(F.col("level") <= k, F.col("end"))).over(order)) for k in sorted({r[2] for r in table})], F.lit(-1))
    df = df.withColumn("__hidden", F.col("rule").isNotNull() & (reach >= F.col("end")))
    blank = lambda c: F.when(~F.col("__hidden"), F.col(c)).alias(c)
    return df.select(*[c if c not in new[3:] else blank(c) for c in [*kept, "places", *new[3:]]])


def labels(docs: DataFrame) -> DataFrame:
    """Base places, labels and score of every document."""
    d = scan(docs.select("doc_id", "text"), drop=("text",))
    d = d.groupBy("row", "doc_id", "n_words", "places").agg(F.collect_set("label").alias("own"), F.max("confidence").alias("best"))
    p, sorted_join = F.col("places"), lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base = F.transform(p, lambda x: x["label"])
    return d.select("doc_id", "n_words", F.size(p).cast("long").alias("n_base"), F.array_min(F.transform(p, lambda x: x["start"])).alias("first_word"),
                    F.array_max(F.transform(p, lambda x: x["start"])).alias("last_word"), sorted_join(base).alias("base_labels"), sorted_join(F.concat(base, "own")).alias("labels"),
                    F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size(p) > 0, 0.9).otherwise(0.0)).alias("score"))


def labels_sql() -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {q(label)}, {level}, {conf}, {q(kw)}, {q(b)}, {q(a)})" for k, label, level, conf, kw, b, a in rules())
    n = lambda m: f"(CASE WHEN trim({m}) = '' THEN 0 ELSE len(string_split(trim({m}), ' ')) END)"
    return rf"""
WITH r(rule, label, level, confidence, kw, before, after) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, w, unnest(w) AS kw, unnest(range(len(w))) AS pos FROM d WHERE len(w) > 0),
a AS (SELECT rid, kw, pos, array_to_string(w[greatest(1, pos - {REACH - 1}):pos], ' ') AS l, array_to_string(w[pos + 2:pos + {REACH + 1}], ' ') AS g,
  CASE WHEN kw <> 'license' THEN NULL WHEN w[pos] = 'mit' THEN 'mit' WHEN w[pos] = 'apache' THEN 'apache' WHEN w[pos] = 'public' AND pos > 1 AND w[pos - 1] = 'general' THEN 'gpl' END AS base
  FROM t WHERE kw IN (SELECT kw FROM r)),
b AS (SELECT rid, count(*) AS n_base, min(pos - CASE base WHEN 'gpl' THEN 2 ELSE 1 END) AS first_word, max(pos - CASE base WHEN 'gpl' THEN 2 ELSE 1 END) AS last_word, list(DISTINCT base) AS bl
  FROM a WHERE base IS NOT NULL GROUP BY rid),
h AS (SELECT rid, rule, label, level, confidence, pos - {n("regexp_extract(l, before)")} AS s, pos + 1 + {n("regexp_extract(g, after)")} AS e
  FROM a JOIN r USING (kw) WHERE regexp_matches(l, before) AND regexp_matches(g, after)),
k AS (SELECT rid, list(DISTINCT label) AS own, max(confidence) AS best FROM h WHERE NOT EXISTS (SELECT 1 FROM h AS o WHERE o.rid = h.rid AND o.level <= h.level AND o.s <= h.s AND o.e >= h.e
  AND (o.s, -o.e, o.level, o.rule) < (h.s, -h.e, h.level, h.rule)) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(bl, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(own, [])))), ',') AS labels,
  CAST(greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN 0.9 ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)"""
