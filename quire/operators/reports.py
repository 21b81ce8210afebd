"""Aggregations and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import shorten, squeeze, word_count
from quire.session import top_k


def present(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) != ""


def percent(part: Column, whole: Column, digits: int = 1, empty: float = 0.0) -> Column:
    """Share in percent; ``empty`` where the whole is zero."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(empty))


def library_stats(papers: DataFrame) -> DataFrame:
    """Totals, by status and by year in one pass over the table (grouping sets)."""
    flags = papers.select("read_status", "year", "rating", present("abstract").alias("has_abstract"),
                          present("doi").alias("has_doi"))
    grouped = flags.groupingSets([["read_status"], ["year"], []], "read_status", "year").agg(
        F.count("*").alias("papers"),
        percent(F.count_if("has_abstract"), F.count("*")).alias("abstract_percent"),
        percent(F.count_if("has_doi"), F.count("*")).alias("doi_percent"),
        F.round(F.avg("rating"), 2).alias("avg_rating"),
        F.grouping("read_status").alias("_s"), F.grouping("year").alias("_y"))
    facet = F.when(F.col("_s") == 0, "status").when(F.col("_y") == 0, "year").otherwise("total")
    value = F.when(F.col("_s") == 0, F.col("read_status")).when(F.col("_y") == 0, F.col("year").cast("string"))
    return grouped.select(facet.alias("facet"), value.alias("value"), "papers", "abstract_percent", "doi_percent",
                          "avg_rating")


def top_years(papers: DataFrame, k: int = 10) -> DataFrame:
    """Most recent years with their paper counts (a top-k report)."""
    return (papers.filter(F.col("year").isNotNull()).groupBy("year").agg(F.count("*").alias("papers"))
            .orderBy(F.desc("year")).limit(k))


def _ids(t: DataFrame, flag: str, key: str = "paper_id") -> DataFrame:
    return t.select(F.col(key).alias("id")).distinct().withColumn(flag, F.lit(True))


def flagged(papers: DataFrame, **tables: DataFrame) -> DataFrame:
    """Papers with one boolean per table: does it hold a row for the paper?"""
    out = papers
    for name, t in tables.items():
        out = out.join(_ids(t, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def extraction_coverage(papers: DataFrame, chunks: DataFrame, contents: DataFrame) -> DataFrame:
    """A02."""
    f = flagged(papers.select("id", present("abstract").alias("has_abstract")), has_text=chunks, extracted=contents)
    able = F.col("has_text") | F.col("has_abstract")
    return f.agg(
        F.count("*").alias("total"), F.count_if("has_text").alias("with_text"),
        F.count_if("has_abstract").alias("with_abstract"), F.count_if("extracted").alias("extracted"),
        F.count_if(able & ~F.col("extracted")).alias("needing"),
        percent(F.count_if("extracted"), F.count("*"), 1, 100.0).alias("coverage_percent"))


def chunk_owner(chunk_id: Column) -> Column:
    """Paper id inside a ``{paper}_{index}`` chunk id."""
    return F.regexp_extract(chunk_id, "^(.*)_[^_]*$", 1).try_cast("long")


def embedding_needs(papers: DataFrame, chunks: DataFrame, paper_vectors: DataFrame, chunk_vectors: DataFrame) -> DataFrame:
    """Per paper, what still has to be embedded."""
    owners = chunk_vectors.select(chunk_owner(F.col("chunk_id")).alias("paper_id"))
    f = flagged(papers.select("id", present("abstract").alias("has_abstract")), has_text=chunks,
                has_vector=paper_vectors.select(F.col("id").alias("paper_id")), has_chunk_vectors=owners)
    return f.withColumn("needs_paper_vector", F.col("has_abstract") & ~F.col("has_vector")).withColumn(
        "needs_chunk_vectors", F.col("has_text") & ~F.col("has_chunk_vectors"))


def embedding_coverage(needs: DataFrame) -> DataFrame:
    """One-row report over :func:`embedding_needs`."""
    return needs.agg(
        F.count("*").alias("total"), F.count_if("has_vector").alias("with_vector"),
        F.count_if("has_chunk_vectors").alias("with_chunk_vectors"),
        F.count_if("needs_paper_vector").alias("needing_paper_vector"),
        F.count_if("needs_chunk_vectors").alias("needing_chunk_vectors"),
        percent(F.count_if("has_vector"), F.count("*")).alias("coverage_percent"))


def validation_coverage(papers: DataFrame) -> DataFrame:
    """By validation status and identifier class, one pass."""
    is_ = lambda s: F.count_if(F.col("validation_status") == s)
    return papers.agg(
        F.count("*").alias("total"), is_("verified").alias("verified"), is_("not_found").alias("not_found"),
        is_("error").alias("error"), is_("unvalidated").alias("unvalidated"),
        F.count_if(present("doi")).alias("with_doi"), F.count_if(present("arxiv_id")).alias("with_arxiv"),
        F.count_if(~present("doi") & ~present("arxiv_id")).alias("title_only"),
        percent(F.count_if(F.col("validation_status").isin("verified", "not_found", "error")), F.count("*")).alias("validated_percent"))


def queue_stats(papers: DataFrame, meta: DataFrame) -> DataFrame:
    """Queue counts by status; NULL counts as none."""
    status = meta.select(F.coalesce("chunking_status", F.lit("none")).alias("s"))
    counts = [F.count_if(F.col("s") == s).alias(s) for s in ("pending", "processing", "complete", "failed", "none")]
    with_pdf = papers.agg(F.count_if(F.col("file_path").isNotNull()).alias("n"))
    return status.agg(*counts).withColumn("total_with_pdf", with_pdf.scalar())


def chunk_stats(papers: DataFrame, chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """A06."""
    pdfs = papers.agg(F.count("*").alias("total"), F.count_if(present("file_path")).alias("with_pdf"))
    have = chunks.agg(F.count_distinct("paper_id").alias("with_chunks"), F.count("*").alias("total_chunks"))
    bare = meta.filter("chunking_status = 'complete'").join(chunks.select("paper_id"), "paper_id", "left_anti")
    stuck = meta.agg(F.count_if(F.col("chunking_status") == "processing").alias("n"))
    return pdfs.select(
        "total", "with_pdf", have.select("with_chunks").scalar().alias("with_chunks"),
        have.select("total_chunks").scalar().alias("total_chunks"),
        (F.col("with_pdf") - have.select("with_chunks").scalar()).alias("need_chunks"),
        stuck.scalar().alias("stuck_processing"),
        bare.agg(F.count("*").alias("n")).scalar().alias("stuck_complete_no_chunks"))


def tier_stats(papers: DataFrame, contents: DataFrame, chunks: DataFrame, relevances: DataFrame) -> DataFrame:
    """Review and quick-tier statistics from one flag row per paper."""
    rel = relevances.groupBy(F.col("paper_id").alias("id")).agg(
        F.bool_or(F.col("level") == "high").alias("high"), F.bool_or(F.col("level") == "medium").alias("medium"))
    dates = contents.select(F.col("paper_id").alias("id"), F.col("quick_date").isNotNull().alias("quick"),
                            F.col("deep_date").isNotNull().alias("deep"))
    f = flagged(papers.select("id", present("abstract").alias("has_abstract")), has_text=chunks)
    f = f.join(rel, "id", "left").join(dates, "id", "left").na.fill(False)
    todo = F.col("quick") & ~F.col("deep") & (F.col("high") | F.col("medium"))
    return f.agg(
        F.count("*").alias("total"), F.count_if("has_abstract").alias("with_abstract"),
        F.count_if("quick").alias("quick_done"), F.count_if("deep").alias("deep_done"),
        F.count_if(F.col("has_abstract") & ~F.col("quick")).alias("need_quick"),
        F.count_if("high").alias("high_relevance"), F.count_if("medium").alias("medium_relevance"),
        F.count_if(todo & F.col("has_text")).alias("ready_for_review"),
        F.count_if(todo & ~F.col("has_text")).alias("missing_full_text"))


def chunk_length_stats(chunks: DataFrame, by: str) -> DataFrame:
    """Chunk lengths per source and, as the NULL group, over everything."""
    n = F.length("content")
    return chunks.rollup(by).agg(
        F.count("*").alias("chunks"), F.coalesce(F.sum(n), F.lit(0)).alias("total_chars"),
        F.coalesce(F.round(F.avg(n), 4), F.lit(0.0)).alias("avg_chars"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_chars"), F.coalesce(F.max(n), F.lit(0)).alias("max_chars"))


def suggest_tags(neighbours: DataFrame, tags: DataFrame, k: int = 5) -> DataFrame:
    """Tags most frequent among a paper's neighbours (``id``, ``neighbour_id``), minus its own."""
    seen = neighbours.join(tags.select(F.col("paper_id").alias("neighbour_id"), "tag"), "neighbour_id")
    counts = seen.groupBy("id", "tag").agg(F.count("*").alias("votes"))
    fresh = counts.join(tags.select(F.col("paper_id").alias("id"), "tag"), ["id", "tag"], "left_anti")
    return top_k(fresh, ["id"], [F.desc("votes"), F.col("tag")], k, "rank")


def full_text(chunks: DataFrame) -> DataFrame:
    """A10: chunks of a paper in order, joined by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_order", "content")))
    return chunks.groupBy("paper_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["content"]), "\n\n").alias("text"),
        F.count("*").alias("chunks"))


def from_inverted_index(df: DataFrame, key: str = "id", index: str = "inverted_index") -> DataFrame:
    """Text rebuilt from a {word: [positions]} map, inside the row."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(
        e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word")))))
    return df.select(key, F.array_join(F.transform(F.array_sort(pairs), lambda s: s["word"]), " ").alias("abstract"))


def collection_counts(collections: DataFrame, paper_collections: DataFrame) -> DataFrame:
    """Papers and children per collection, zero where there are none."""
    n = paper_collections.groupBy(F.col("collection_id").alias("id")).agg(F.count("paper_id").alias("papers"))
    kids = collections.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    return collections.join(n, "id", "left").join(kids, "id", "left").na.fill(0, ["papers", "children"])


def doc_metrics(chunks: DataFrame) -> DataFrame:
    """Words and characters per chunk, totalled per paper."""
    sized = chunks.select("paper_id", word_count(F.trim("content")).alias("w"), F.length("content").alias("c"))
    return sized.groupBy("paper_id").agg(
        F.count("*").alias("chunks"), F.sum("w").alias("words"), F.sum("c").alias("chars"))


def verification_summary(results: DataFrame) -> DataFrame:
    """A14."""
    return results.agg(
        F.count("*").alias("verified"), F.count_if(F.col("routing") == "accept").alias("accepted"),
        F.count_if(F.col("routing").isin("review", "reextract")).alias("needs_review"),
        F.round(F.avg("score"), 2).alias("avg_score"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def rerank_summary(reranked: DataFrame) -> DataFrame:
    """How far the rerank moved results, per query."""
    change = F.col("original_rank") - F.col("new_rank")
    return reranked.groupBy("query_id").agg(
        F.count("*").alias("results"), F.round(F.avg(change), 6).alias("avg_rank_change"),
        F.max(change).alias("max_promotion"), F.min(change).alias("max_demotion"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def search_health(papers: DataFrame, indexed: DataFrame, vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """One-row health report with warnings, recommendations and an overall status.

    ``indexed`` and ``vectors`` hold ``paper_id``.
    """
    f = flagged(papers.select("id"), indexed=indexed, has_vector=vectors, has_text=chunks)
    base = f.agg(
        F.count("*").alias("total_papers"), F.count_if("indexed").alias("indexed"),
        F.count_if("has_vector").alias("with_vector"), F.count_if("has_text").alias("with_text"))
    base = base.withColumn("coverage_percent", percent(F.col("with_vector"), F.col("total_papers")))
    drift = F.col("indexed") != F.col("total_papers")
    low = (F.col("with_vector") > 0) & (F.col("coverage_percent") < 50)
    missing_text = F.col("total_papers") - F.col("with_text")
    kept = lambda *cases: F.filter(F.array(*cases), lambda x: x.isNotNull())
    out = base.withColumn("warnings", kept(
        F.when(F.col("indexed") == 0, F.lit("text index empty")),
        F.when((F.col("indexed") > 0) & drift, F.format_string("text index out of sync: %d indexed, %d total papers", "indexed", "total_papers")),
        F.when(F.col("with_vector") == 0, F.lit("no vectors - semantic search will not work")),
        F.when(low, F.concat(F.lit("low vector coverage ("), F.col("coverage_percent").cast("string"), F.lit("%)"))),
    )).withColumn("recommendations", kept(
        F.when(drift, F.lit("rebuild the text index")),
        F.when(F.col("with_vector") < F.col("total_papers"),
               F.format_string("embed %d papers", F.col("total_papers") - F.col("with_vector"))),
        F.when(F.col("with_text") < F.col("total_papers") * 0.5, F.format_string("%d papers missing full text", missing_text)),
    ))
    broken = (F.col("total_papers") > 0) & (F.col("indexed") == 0) & (F.col("with_vector") == 0)
    return out.withColumn("status", F.when(broken, "unhealthy").when(F.size("warnings") > 0, "degraded").otherwise("healthy"))


def validation_outcomes(results: DataFrame, messages: int = 10) -> DataFrame:
    """Outcome counts with the first error messages; messages are picked before they are collected."""
    counts = results.groupBy("status").agg(F.count("*").alias("papers"))
    first = top_k(results.filter("message IS NOT NULL"), ["status"], [F.col("paper_id")], messages, "n")
    text = F.transform(F.array_sort(F.collect_list(F.struct("n", "message"))), lambda s: s["message"])
    return counts.join(first.groupBy("status").agg(text.alias("messages")), "status", "left")


def by_source(results: DataFrame, k: int) -> DataFrame:
    """Top results of each source, abstract shortened for display."""
    out = top_k(results, ["source"], [F.desc("score"), F.col("id")], k, "rank")
    return out.withColumn("abstract", shorten(squeeze("abstract"), 200))
