"""Quality rules, audit and repair (Q06-Q14)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions import vocab
from quire.functions.text import word_count
from quire.operators.reports import present
from quire.operators.sets import key_presence
from quire.session import top_k


def kept(*cases: Column) -> Column:
    """Array of the cases that hold."""
    return F.filter(F.array(*cases), lambda c: c.isNotNull())


def extraction_quality(papers: DataFrame, contents: DataFrame) -> DataFrame:
    """Q06: six rules per extraction; 0.3 off per issue, 0.1 per warning, review below 0.7."""
    c = contents.select(
        F.col("paper_id").alias("id"), "one_sentence_summary", "paper_type", "key_findings", "methodology_summary",
        "topics", F.coalesce(F.size("quantitative_results"), F.lit(0)).alias("n_quant"))
    d = c.join(papers.select("id", "title", "abstract", "word_count"), "id")
    summary = F.length(F.coalesce("one_sentence_summary", F.lit("")))
    words = F.coalesce("word_count", F.lit(0))
    findings = F.greatest(F.coalesce(F.size("key_findings"), F.lit(0)), F.lit(0))
    article = F.coalesce(F.col("paper_type") == "research_article", F.lit(False))
    title_words = F.array_distinct(F.filter(F.split(F.lower("title"), r"\s+"), lambda w: w != ""))
    topic_words = F.filter(F.split(F.lower(F.array_join("topics", " ")), r"\s+"), lambda w: w != "")
    numeric = F.coalesce(F.col("abstract").rlike(r"\d+\.?\d*\s*[%°CKÅnm]"), F.lit(False))
    out = d.withColumn("issues", kept(
        F.when((words > 500) & (summary < 50), F.lit("summary_too_short")),
    )).withColumn("warnings", kept(
        F.when(article & (findings < 3), F.lit("few_key_findings")),
        F.when(article & (F.length(F.coalesce("methodology_summary", F.lit(""))) < 50), F.lit("methodology_brief")),
        F.when((F.col("paper_type") == "review") & (words < 5000), F.lit("review_too_short")),
        F.when(numeric & (F.col("n_quant") <= 0), F.lit("no_quantitative_results")),
        F.when((F.size("topics") > 0) & (F.size(title_words) > 3) & ~F.arrays_overlap(title_words, topic_words),
               F.lit("topics_off_title")),
    ))
    score = F.greatest(F.lit(0.0), F.round(1.0 - 0.3 * F.size("issues") - 0.1 * F.size("warnings"), 6))
    return out.select("id", "title", "issues", "warnings", score.alias("score"), (score < 0.7).alias("needs_review"))


def quality_report(quality: DataFrame) -> DataFrame:
    """Q06: one-row summary."""
    return quality.agg(
        F.count("*").alias("checked"), F.count_if(F.size("issues") > 0).alias("with_issues"),
        F.count_if("needs_review").alias("needs_review"), F.round(F.avg("score"), 2).alias("avg_score"))


# fixed values: signs that a lending cover page replaced the article
COVER_PAGE_SIGNS = [
    "interlibrary loan",
    "document delivery",
    "illiad",
    "loansome doc",
    "university of washington libraries",
    "copyright notice",
    "this document may not be posted",
]


def text_quality(docs: DataFrame, *, text: str = "text", abstract: str = "abstract", words: str | Column | None = None,
                 signs: list[str] | None = None, missing: bool = True) -> DataFrame:
    """Q07: cover-page signs at the head of the text, missing abstract, too few words for the length.

    With ``missing`` false an empty text is judged by the same signs as any other.
    """
    signs = COVER_PAGE_SIGNS if signs is None else signs
    body = F.coalesce(F.col(text), F.lit(""))
    count = word_count(text) if words is None else words
    # a dotted capital I is an i as well; Java's lower case adds a mark to it
    head = F.lower(F.translate(F.substring(body, 1, 2000), "\u0130", "i"))
    cover = reduce(lambda a, b: a | b, [F.contains(head, F.lit(s)) for s in signs])
    no_abstract = ~present(abstract) & (F.length(body) > 1000)
    few_words = (F.length(body) > 5000) & (count > 0) & (count < 500)
    issues = kept(F.when(cover, F.lit("cover_page")), F.when(no_abstract, F.lit("missing_abstract")),
                  F.when(few_words, F.lit("low_word_count")))
    empty = (body == "") if missing else F.lit(False)
    quality = (F.when(empty, "missing").when(cover, "contaminated").when(no_abstract | few_words, "suspect")
               .otherwise("good"))
    advice = (F.when(empty, "enrich").when(cover | few_words, "vision").when(no_abstract, "enrich").otherwise("text"))
    return docs.select("*", F.when(empty, F.array(F.lit("no_text"))).otherwise(issues).alias("issues"),
                       quality.alias("quality"), advice.alias("recommendation"))


# --- audit ---------------------------------------------------------------------------
@dataclass
class Library:
    """Tables the audit reads.  ``key_findings`` is an array, ``claims`` the evidence array of a verification."""

    papers: DataFrame
    contents: DataFrame
    chunks: DataFrame
    meta: DataFrame
    notes: DataFrame
    refs: DataFrame
    indexed: DataFrame  # paper_id of every indexed paper


def _empty_summary() -> Column:
    return F.trim(F.coalesce("deep_one_sentence_summary", "one_sentence_summary", F.lit(""))) == ""


def _empty_extraction() -> Column:
    none = F.coalesce(F.size("key_findings"), F.lit(0)) <= 0
    return (F.coalesce(F.col("extraction_depth"), F.lit("")) == "comprehensive") & _empty_summary() & none


def actual_counts(lib: Library) -> DataFrame:
    """Recorded chunk counts beside the counted ones (one aggregation, no correlated query)."""
    n = lib.chunks.groupBy("paper_id").agg(F.count("*").alias("actual"))
    return lib.meta.join(n, "paper_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))


def _orphans(child: DataFrame, papers: DataFrame) -> DataFrame:
    ids = papers.select(F.col("id").alias("paper_id"))
    return child.filter("paper_id IS NOT NULL").join(ids, "paper_id", "left_anti")


def silent_failures(lib: Library) -> dict[str, tuple[str, DataFrame]]:
    """Q08: rows that claim success without the goods."""
    counts = actual_counts(lib)
    return {
        "empty_extraction_marked_complete": ("error", lib.contents.filter(_empty_extraction()).select("paper_id")),
        "deep_date_without_any_summary": (
            "error", lib.contents.filter(F.col("deep_date").isNotNull() & _empty_summary()).select("paper_id")),
        "chunking_complete_without_chunks": (
            "error", counts.filter("chunking_status = 'complete' AND actual = 0").select("paper_id")),
        "chunk_count_mismatch": ("warn", counts.filter("chunk_count <> actual").select("paper_id")),
        "empty_chunks": ("error", lib.chunks.filter(~present("content")).select("paper_id")),
    }


def structural_failures(lib: Library) -> dict[str, tuple[str, DataFrame]]:
    """Q09: orphans in five child tables, missing titles, shared DOIs, index drift."""
    papers = lib.papers
    shared = papers.filter(present("doi")).groupBy(F.lower("doi").alias("doi")).agg(
        F.count("*").alias("n"), F.min("id").alias("paper_id")).filter("n > 1")
    drift = papers.select(F.col("id").alias("paper_id")).join(lib.indexed.select("paper_id"), "paper_id", "left_anti")
    return {
        "orphan_chunks": ("error", _orphans(lib.chunks, papers).select("paper_id")),
        "orphan_extraction_metadata": ("error", _orphans(lib.meta, papers).select("paper_id")),
        "orphan_paper_contents": ("error", _orphans(lib.contents, papers).select("paper_id")),
        "orphan_notes": ("error", _orphans(lib.notes, papers).select("paper_id")),
        "orphan_references": ("warn", _orphans(lib.refs, papers).select("paper_id")),
        "missing_title": ("error", papers.filter(~present("title")).select(F.col("id").alias("paper_id"))),
        "duplicate_doi": ("warn", shared.select("paper_id")),
        "index_drift": ("error", drift),
    }


def outage_rows(contents: DataFrame) -> DataFrame:
    """Q10: verifications in which not one claim got a verdict.

    ``verification`` is a VARIANT; the claims are projected from it.
    """
    claims = F.try_variant_get("verification", "$.evidence.claims", "array<struct<supported:boolean>>")
    return contents.filter((F.size(claims) > 0) & F.forall(claims, lambda c: c["supported"].isNull()))


def findings(checks: dict[str, tuple[str, DataFrame]], samples: int = 10) -> DataFrame:
    """Audit report: key, severity, count and the first ids of every check.

    Bad rows of all checks are counted together; samples are picked per key before they
    are collected, so no group of bad rows is gathered whole.
    """
    keys = reduce(DataFrame.unionByName, [
        rows.select(F.lit(key).alias("check_key"), F.lit(sev).alias("severity"), "paper_id")
        for key, (sev, rows) in checks.items()])
    spark = keys.sparkSession
    named = spark.createDataFrame([(k, s) for k, (s, _) in checks.items()], "check_key string, severity string")
    counts = keys.groupBy("check_key").agg(F.count("*").alias("bad_rows"))
    few = top_k(keys.select("check_key", "paper_id").distinct(), ["check_key"], [F.col("paper_id")], samples, "n")
    few = few.groupBy("check_key").agg(F.array_sort(F.collect_list("paper_id")).alias("samples"))
    out = named.join(counts, "check_key", "left").join(few, "check_key", "left")
    return out.withColumn("bad_rows", F.coalesce("bad_rows", F.lit(0))).withColumn(
        "samples", F.coalesce("samples", F.array().cast("array<bigint>")))


def repair(lib: Library) -> tuple[Library, DataFrame]:
    """Q11: repaired tables and the rows each repair touched."""
    ids = lib.papers.select(F.col("id").alias("paper_id"))
    alive = lambda t: t.join(ids, "paper_id", "left_semi")
    bad = _empty_extraction()
    contents = lib.contents
    if "verification" in contents.columns:
        out = outage_rows(contents).select("paper_id").distinct().withColumn("_out", F.lit(True))
        contents = contents.join(out, "paper_id", "left")
        clear = lambda c: F.when(F.col("_out").isNull(), F.col(c)).alias(c)
        contents = contents.select(*[clear(c) if c in ("verification", "verification_score") else F.col(c)
                                     for c in lib.contents.columns])
    fixed = contents.withColumn("_bad", bad)
    fixed = fixed.withColumn("extraction_depth", F.when(~F.col("_bad"), F.col("extraction_depth")))
    fixed = fixed.withColumn("deep_date", F.when(~F.col("_bad"), F.col("deep_date"))).drop("_bad")
    meta = actual_counts(lib).withColumn(
        "chunk_count", F.when(F.col("chunk_count").isNotNull(), F.col("actual"))).drop("actual")
    done = Library(lib.papers, alive(fixed), alive(lib.chunks), alive(meta), lib.notes, lib.refs, lib.indexed)
    checks = {**silent_failures(lib), **structural_failures(lib)}
    repaired = ["empty_extraction_marked_complete", "chunk_count_mismatch", "orphan_chunks",
                "orphan_extraction_metadata", "orphan_paper_contents"]
    touched = {k: checks[k] for k in repaired}
    if "verification" in lib.contents.columns:
        touched["verification_written_during_outage"] = ("error", outage_rows(lib.contents).select("paper_id"))
    return done, findings(touched).select("check_key", F.col("bad_rows").alias("repaired"))


def review_queue(contents: DataFrame, accept: float = 0.85, limit: int | None = None) -> DataFrame:
    """Q12: scored below the accept bar, worst first."""
    out = contents.filter(F.col("verification_score") < accept)
    return out if limit is None else out.orderBy("verification_score", "paper_id").limit(limit)


def validate_records(papers: DataFrame) -> DataFrame:
    """Q13: errors (title, authors) and warnings (year, doi or url) per record."""
    errors = kept(F.when(~present("title"), F.lit("missing title")),
                  F.when(F.coalesce(F.size("authors"), F.lit(0)) <= 0, F.lit("missing authors")))
    url = present("url") if "url" in papers.columns else F.lit(False)
    warnings = kept(F.when(F.col("year").isNull(), F.lit("missing year")),
                    F.when(~present("doi") & ~url, F.lit("missing doi or url")))
    return papers.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("is_valid", F.size("errors") == 0)


# fixed values: fields every bibliography entry must carry
REQUIRED_ENTRY_FIELDS = ["author", "title", "year"]


def incomplete_entries(entries: DataFrame) -> DataFrame:
    """Q13: bibliography entries with the required fields they lack."""
    missing = F.array_except(F.array(*[F.lit(f) for f in REQUIRED_ENTRY_FIELDS]), F.map_keys("fields"))
    return entries.withColumn("missing", missing).filter(F.size("missing") > 0)


def bib_health(entries: DataFrame, citations: DataFrame) -> DataFrame:
    """Q13: one-row summary of a bibliography against the keys cited in the text."""
    keys = key_presence(entries.select("key"), citations.select("key"), "key", "orphan", "missing")
    per_doi = entries.select(F.col("fields")["doi"].alias("doi")).filter("doi IS NOT NULL").groupBy("doi").count()
    out = keys.agg(
        F.count_if(F.col("presence") != "missing").alias("entries"),
        F.count_if(F.col("presence") != "orphan").alias("cited"),
        F.count_if(F.col("presence") == "orphan").alias("orphans"),
        F.count_if(F.col("presence") == "missing").alias("missing"))
    out = out.withColumn("incomplete", incomplete_entries(entries).agg(F.count("*")).scalar())
    out = out.withColumn("duplicates", F.coalesce(per_doi.agg(F.sum(F.col("count") - 1)).scalar(), F.lit(0)))
    trouble = F.col("orphans") + F.col("missing") + F.col("incomplete") + F.col("duplicates")
    return out.withColumn("status", F.when(trouble == 0, "healthy").otherwise("issues_found"))


def invalid_rows(papers: DataFrame) -> DataFrame:
    """Q14: values outside their enum or range."""
    outside = lambda c, ok: F.col(c).isNotNull() & ~F.col(c).isin(ok)
    problems = kept(
        F.when(outside("read_status", vocab.READ_STATUSES), F.lit("read_status")),
        *([F.when(outside("enrichment_status", vocab.ENRICHMENT_STATUSES), F.lit("enrichment_status"))]
          if "enrichment_status" in papers.columns else []),
        F.when(F.col("rating").isNotNull() & ~F.col("rating").between(1, 5), F.lit("rating")))
    return papers.withColumn("problems", problems).filter(F.size("problems") > 0)
