"""Joins that complete result rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import doi_key


def deep_first(deep: str, quick: str) -> Column:
    """Deep value unless missing or empty, then the quick one."""
    return F.coalesce(F.nullif(F.col(deep), F.lit("")), F.col(quick))


def enrich(results: DataFrame, contents: DataFrame) -> DataFrame:
    """Extraction fields beside each result, deep tier preferred."""
    fields = contents.select(
        F.col("paper_id").alias("id"),
        deep_first("deep_one_sentence_summary", "one_sentence_summary").alias("summary"),
        deep_first("deep_paper_type", "paper_type").alias("paper_type"),
        *([F.coalesce(F.when(F.size("deep_topics") > 0, F.col("deep_topics")), F.col("topics")).alias("_topics")]
          if "topics" in contents.columns else []),
    )
    out = results.join(fields, "id", "left")
    if "_topics" in out.columns:
        out = out.withColumn("topics", F.coalesce("_topics", F.array().cast("array<string>"))).drop("_topics")
    return out


def author_lists(paper_authors: DataFrame, authors: DataFrame) -> DataFrame:
    """One ordered name array per paper, built before any join to papers."""
    named = paper_authors.join(authors, paper_authors.author_id == authors.id)
    ordered = F.array_sort(F.collect_list(F.struct("position", "name")))
    return named.groupBy("paper_id").agg(F.transform(ordered, lambda s: s["name"]).alias("authors"))


def tag_lists(paper_tags: DataFrame) -> DataFrame:
    return paper_tags.groupBy("paper_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def with_authors_tags(papers: DataFrame, paper_authors: DataFrame, authors: DataFrame, paper_tags: DataFrame) -> DataFrame:
    """Papers with their author and tag arrays (empty when they have none)."""
    none = F.array().cast("array<string>")
    out = papers.join(author_lists(paper_authors, authors).withColumnRenamed("paper_id", "id"), "id", "left")
    out = out.join(tag_lists(paper_tags).withColumnRenamed("paper_id", "id"), "id", "left")
    return out.withColumn("authors", F.coalesce("authors", none)).withColumn("tags", F.coalesce("tags", none))


def needing(papers: DataFrame, have: list[DataFrame], lack: list[DataFrame]) -> DataFrame:
    """Papers with a row in every ``have`` table and none in any ``lack`` table (key ``paper_id``)."""
    out = papers
    for t in have:
        out = out.join(t.select(F.col("paper_id").alias("id")), "id", "left_semi")
    for t in lack:
        out = out.join(t.select(F.col("paper_id").alias("id")), "id", "left_anti")
    return out


def lacking_deep(papers: DataFrame, contents: DataFrame) -> DataFrame:
    """No extraction, or one that is not comprehensive."""
    depth = contents.select(F.col("paper_id").alias("id"), "extraction_depth")
    return papers.join(depth, "id", "left").filter(
        F.col("extraction_depth").isNull() | (F.col("extraction_depth") != "comprehensive"))


def claim_links(claims: DataFrame) -> DataFrame:
    """The parallel arrays of a claim as one row per position."""
    zipped = F.arrays_zip("reference_ids", "matched_paper_ids", "match_statuses")
    return claims.select("claim_id", "paper_id", F.posexplode(zipped).alias("pos", "z")).select(
        "claim_id", "paper_id", "pos", F.col("z.reference_ids").alias("reference_id"),
        F.col("z.matched_paper_ids").alias("matched_paper_id"), F.col("z.match_statuses").alias("match_status"))


def claims_citing(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """Claims whose matched papers contain p, for every p; a claim counts once per paper."""
    pairs = claims.select("claim_id", F.explode(F.array_distinct("matched_paper_ids")).alias("id"))
    return pairs.join(papers, "id")


def flag_in_library(results: DataFrame, papers: DataFrame) -> DataFrame:
    """Membership by normalised DOI.  Library keys are made unique first, so results never multiply."""
    known = papers.select(doi_key("doi").alias("_doi"), F.col("id").alias("library_id"))
    known = known.filter("_doi IS NOT NULL").groupBy("_doi").agg(F.min("library_id").alias("library_id"))
    out = results.withColumn("_key", doi_key("doi")).join(known, F.col("_key") == F.col("_doi"), "left")
    return out.withColumn("in_library", F.col("library_id").isNotNull()).drop("_key", "_doi")


def length_window(length: Column, threshold: float) -> tuple[Column, Column]:
    """Shortest and longest partner a 2M/T ratio of ``threshold`` allows, with a margin of ten.

    Products are exact decimals and only the quotient is a double, as in SQL with decimal constants.
    """
    short = Decimal(str(threshold))
    part = lambda x, y: ((length * F.lit(x)).cast("double") / float(y)).cast("int")
    return F.greatest(part(short, 2 - short) - 10, F.lit(1)), part(2 - short, short) + 10


def length_window_join(a: DataFrame, b: DataFrame, threshold: float, *, text: str = "title", width: int = 16) -> DataFrame:
    """Pairs whose text lengths are within each other's window, as an equi join on length bands."""
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    low, high = length_window(F.length(f"a_{text}"), threshold)
    left = left.withColumn("_band", F.explode(F.sequence((low / width).cast("int"), (high / width).cast("int"))))
    right = right.withColumn("_band", (F.length(f"b_{text}") / width).cast("int"))
    return left.join(right, "_band").filter(F.length(f"b_{text}").between(low, high)).drop("_band")


def unmatched_refs(refs: DataFrame, papers: DataFrame, *, doi_only: bool = False, k: int | None = None) -> DataFrame:
    """Unmatched references with their source paper, most confident first."""
    out = refs.filter(F.col("match_status") == "unmatched")
    if doi_only:
        out = out.filter(F.col("parsed_doi").isNotNull())
    titles = papers.select(F.col("id").alias("paper_id"), F.col("title").alias("source_title"))
    out = out.join(titles, "paper_id")
    if k is None:
        return out
    return out.orderBy(F.desc("parse_confidence"), "paper_id", "reference_order", "reference_id").limit(k)


def candidate_counts(papers: DataFrame, chunks: DataFrame, relevances: DataFrame) -> DataFrame:
    """Chunk counts and a relevance map beside each paper, without correlated subqueries."""
    n = chunks.groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("chunk_count"))
    rel = relevances.groupBy(F.col("paper_id").alias("id")).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("project", "level")))).alias("relevances"))
    out = papers.join(n, "id", "left").join(rel, "id", "left")
    return out.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def review_candidates(papers: DataFrame, contents: DataFrame, chunks: DataFrame, relevances: DataFrame,
                      levels: list[str]) -> DataFrame:
    """Quick tier done, not deep, text present, relevance in ``levels``; relevances as a map."""
    quick = contents.filter(F.col("quick_date").isNotNull() & F.col("deep_date").isNull())
    out = needing(papers, [quick, chunks, relevances.filter(F.col("level").isin(levels))], [])
    return candidate_counts(out, chunks, relevances)


def content_view(papers: DataFrame, contents: DataFrame) -> DataFrame:
    """Extraction columns with the open JSON fields, and the tier they amount to."""
    open_field = lambda f: F.try_variant_get("structured_data", f"$.{f}", "string")
    deep = (F.coalesce(F.size("key_findings"), F.lit(0)) > 0) | F.col("methodology_summary").isNotNull()
    for f in ("quantitative_results", "citable_claims", "techniques_used"):
        deep = deep | open_field(f).isNotNull()
    view = contents.select(
        F.col("paper_id").alias("id"), "one_sentence_summary", "key_findings", "methodology_summary",
        open_field("quantitative_results").alias("quantitative_results"),
        open_field("citable_claims").alias("citable_claims"),
        open_field("techniques_used").alias("techniques_used"),
        F.when(deep, "deep").otherwise("quick").alias("tier"))
    return papers.join(view, "id")
