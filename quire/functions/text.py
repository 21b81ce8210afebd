"""Column functions on text: normal forms, keys, numbers, parsed responses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions import vocab

TOKEN = r"([\p{L}\p{N}]+)"
#: Number shapes: strict form used when a quote is grounded, wide form for fidelity checks.
QUOTE_NUMBER = r"(\d+(?:[.,]\d+)?)"
CLAIM_NUMBER = r"(\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: str | Column) -> Column:
    """Collapse whitespace runs and trim."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def tokens(c: str | Column) -> Column:
    """Lower-case letter/digit runs, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOKEN), F.lit(1))


def words(c: str | Column) -> Column:
    """Whitespace-separated words; empty text gives an empty array."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def word_count(c: str | Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def shorten(c: str | Column, n: int, mark: str = "...") -> Column:
    """First ``n`` characters, marked only when something was cut (a display column)."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


# --- normal forms --------------------------------------------------------------------
def clean_query(c: str | Column) -> Column:
    """Keep word characters, spaces, hyphens and quotes."""
    return squeeze(F.regexp_replace(squeeze(c), r"[^\p{L}\p{N}_\s\-'\"]", " "))


def title_plain(c: str | Column) -> Column:
    """Lower case without punctuation."""
    return F.regexp_replace(F.lower(F.trim(col(c))), r"[^\p{L}\p{N}_\s]", "")


def title_ascii(c: str | Column) -> Column:
    """Lower case, ``a-z0-9`` and single spaces."""
    return squeeze(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\s]", ""))


def title_key(c: str | Column) -> Column:
    """Whitespace-collapsed lower case, NULL when empty."""
    return F.nullif(F.lower(squeeze(c)), F.lit(""))


def doi_key(c: str | Column) -> Column:
    """Widest of the accepted identifier spellings, NULL when empty."""
    bare = F.regexp_replace(F.lower(F.trim(col(c))), r"^(https?://)?(dx\.)?doi\.org/|^doi:\s*", "")
    return F.nullif(F.trim(bare), F.lit(""))


def publisher(c: str | Column) -> Column:
    """Publisher from the registrant prefix."""
    table = F.create_map(*[F.lit(x) for kv in vocab.PUBLISHERS.items() for x in kv])
    return table[F.substring(col(c), 1, 7)]


def surname(authors: str | Column) -> Column:
    """First author's surname from a string ("Last, First" or "First Last; ...")."""
    joined = F.regexp_replace(F.regexp_replace(col(authors), " and ", ", "), ";", ",")
    first = words(F.split_part(joined, F.lit(","), F.lit(1)))
    last = F.try_element_at(first, F.lit(-1))
    return F.lower(F.regexp_replace(F.coalesce(last, F.lit("")), "[^a-zA-Z]", ""))


def citation_key(title: str | Column, authors: str | Column, year: str | Column) -> Column:
    """Surname + year + first title word that is not skipped."""
    bare = F.transform(words(title), lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z]", "")))
    kept = F.filter(bare, lambda w: (w != "") & ~w.isin(vocab.KEY_SKIP_WORDS))
    who = F.coalesce(F.nullif(surname(authors), F.lit("")), F.lit("unknown"))
    return F.concat(who, F.coalesce(col(year).cast("string"), F.lit("")),
                    F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit("")))


def content_hash(c: str | Column) -> Column:
    """N18."""
    return F.sha2(col(c), 256)


# --- numbers and quotes --------------------------------------------------------------
def number_tokens(c: str | Column, pattern: str = CLAIM_NUMBER) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(1))


def canonical_number(c: str | Column) -> Column:
    """Value of a number token; thousands commas dropped, exponents read."""
    return F.regexp_replace(col(c), ",", "").try_cast("double")


def numbers(c: str | Column) -> Column:
    return F.filter(F.transform(number_tokens(c), canonical_number), lambda v: v.isNotNull())


def quote_form(c: str | Column) -> Column:
    """Lower case, no quotation marks, no hyphens or dashes, single spaces."""
    bare = F.regexp_replace(col(c), "[\"'‘’“”«»]", "")
    bare = F.regexp_replace(bare, "[-‐-―]", "")
    return squeeze(F.lower(bare))


def content_words(c: str | Column) -> Column:
    """Distinct words of four letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]{4,})"), F.lit(1)))


def overlap_share(wanted: Column, present: Column) -> Column:
    """Share of ``wanted`` found in ``present``; NULL when nothing is wanted."""
    n = F.size(wanted)
    return F.when(n > 0, F.size(F.array_intersect(wanted, present)) / n)


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union (at least 1), two decimals."""
    return F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 2)


def current_status(c: str | Column) -> Column:
    """Legacy enrichment statuses mapped to current ones."""
    table = F.create_map(*[F.lit(x) for kv in vocab.LEGACY_ENRICHMENT.items() for x in kv])
    return F.coalesce(table[col(c)], col(c))


# --- model responses (supplied as a table) -------------------------------------------
REQUIRED_FIELDS = {
    # fixed values: fields each extraction tier must carry
    "quick": ["paper_type", "topics", "one_sentence_summary"],
    "chunk": ["section_type", "facts"],
    "deep": ["paper_type", "topics", "one_sentence_summary", "key_findings", "methodology_summary"],
}


def response_object(c: str | Column) -> Column:
    """VARIANT of the JSON object in a response, NULL when there is none.

    The outermost braces are taken; trailing commas are dropped on a second try.
    Code fences fall away with everything else outside the braces.
    """
    body = F.nullif(F.regexp_extract(col(c), r"(?s)(\{.*\})", 1), F.lit(""))
    repaired = F.regexp_replace(body, r",\s*([}\]])", "$1")
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(repaired))


def missing_fields(obj: str | Column, tier: str) -> Column:
    """Required fields of the tier that are absent or null."""
    obj = col(obj)
    at = lambda f: F.try_variant_get(obj, f"$.{f}", "variant")
    gone = [F.when(at(f).isNull() | F.is_variant_null(at(f)), F.lit(f)) for f in REQUIRED_FIELDS[tier]]
    return F.filter(F.array(*gone), lambda f: f.isNotNull())
