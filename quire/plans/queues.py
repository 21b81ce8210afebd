"""Work queues planned as joins over the library tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.operators.enrich import candidate_counts, needing
from quire.operators.reports import flagged, present


def stage_plan(papers: DataFrame, chunks: DataFrame, contents: DataFrame, paper_vectors: DataFrame,
               chunk_vectors: DataFrame) -> DataFrame:
    """One row per paper with a flag per stage; every id list is a filter on it.

    Vector tables hold ``paper_id``; ``contents`` one row per paper.
    """
    f = flagged(papers.select("id", present("file_path").alias("has_pdf"), present("abstract").alias("has_abstract")),
                chunked=chunks, has_vector=paper_vectors, has_chunk_vectors=chunk_vectors)
    state = contents.select(F.col("paper_id").alias("id"), "extraction_depth", "verification_score")
    f = f.join(state, "id", "left")
    deep = F.coalesce(F.col("extraction_depth") == "comprehensive", F.lit(False))
    return f.select(
        "id", (F.col("has_pdf") & ~F.col("chunked")).alias("backfill"),
        ((F.col("chunked") & ~F.col("has_chunk_vectors")) | (F.col("has_abstract") & ~F.col("has_vector"))).alias("embed"),
        (F.col("chunked") & ~deep).alias("extract"),
        (deep & F.col("verification_score").isNull()).alias("verify"))


def extraction_queue(papers: DataFrame, contents: DataFrame, chunks: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Not extracted but with text or abstract; papers with text first, then newest."""
    todo = flagged(needing(papers, [], [contents]), has_text=chunks)
    todo = todo.filter(F.col("has_text") | present("abstract"))
    if limit is None:
        return todo
    return todo.orderBy(F.desc("has_text"), F.desc("date_added"), F.desc("id")).limit(limit)


def reextraction_queue(papers: DataFrame, contents: DataFrame, *, older_than_days: int | None = None,
                       now: Column | None = None, schema_version: str | None = None, model: str | None = None,
                       limit: int | None = None) -> DataFrame:
    """Extractions by age, schema version or model, oldest first; deep date preferred over quick."""
    done = contents.withColumn("extracted_at", F.coalesce("deep_date", "quick_date"))
    if older_than_days is not None:
        cutoff = (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(older_than_days))
        done = done.filter(F.col("extracted_at") < cutoff)
    if schema_version is not None:
        done = done.filter(F.col("schema_version") == schema_version)
    if model is not None:
        done = done.filter(F.col("extractor_model").ilike(f"%{model}%"))
    out = papers.join(done.withColumnRenamed("paper_id", "id"), "id")
    return out if limit is None else out.orderBy("extracted_at", "id").limit(limit)


def processing_queue(papers: DataFrame, meta: DataFrame, status: str | None = None) -> DataFrame:
    """Papers with a PDF and their processing state; ``needs_extraction`` is a composite status."""
    state = meta.withColumnRenamed("paper_id", "id")
    out = papers.filter(F.col("file_path").isNotNull()).join(state, "id", "left")
    s = F.col("chunking_status")
    if status == "needs_extraction":
        empty = F.coalesce("chunk_count", F.lit(0)) == 0
        out = out.filter(s.isNull() | (s == "none") | ((s == "complete") & empty))
    elif status is not None:
        out = out.filter(s == status)
    return out.withColumn("chunking_status", F.coalesce(s, F.lit("none"))).withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0)))


def fill_queue(papers: DataFrame, meta: DataFrame) -> DataFrame:
    """Papers with a PDF that have no state yet, or the state none."""
    return processing_queue(papers, meta).filter("chunking_status = 'none'").select("id", F.lit("queued").alias("action"))


def validation_order() -> list[Column]:
    """DOI first, then arXiv, then newest."""
    return [F.col("doi").isNull(), F.col("arxiv_id").isNull(), F.desc("date_added"), F.desc("id")]


def validation_queue(papers: DataFrame, limit: int | None = None) -> DataFrame:
    todo = papers.filter(F.col("validation_status") == "unvalidated")
    return todo if limit is None else todo.orderBy(*validation_order()).limit(limit)


def enrichment_queue(papers: DataFrame, status: str, limit: int | None = None) -> DataFrame:
    """Papers in one enrichment status, newest first."""
    todo = papers.filter(F.col("enrichment_status") == status)
    return todo if limit is None else todo.orderBy(F.desc("date_added"), F.desc("id")).limit(limit)


def deep_candidates(papers: DataFrame, contents: DataFrame, chunks: DataFrame, relevances: DataFrame, *,
                    min_rating: int = 4, levels: tuple[str, ...] = ("high",)) -> DataFrame:
    """Quick-only papers worth a deep pass, with the reason; sort by :func:`candidate_order`."""
    quick = contents.filter((F.col("extraction_depth") == "abstract_only") & F.col("deep_date").isNull())
    out = candidate_counts(needing(papers, [quick], []), chunks, relevances)
    relevant = F.coalesce(F.exists(F.map_values("relevances"), lambda v: v.isin(*levels)), F.lit(False))
    rated = F.coalesce(F.col("rating") >= min_rating, F.lit(False))
    reason = F.when(relevant & rated, "both").when(relevant, "high_relevance").when(rated, "high_rating")
    return out.withColumn("flag_reason", reason).filter("flag_reason IS NOT NULL")


def candidate_order() -> list[Column]:
    return [F.desc(F.col("chunk_count") > 0), F.desc(F.col("flag_reason") != "high_rating"),
            F.desc(F.coalesce("rating", F.lit(0))), F.col("id")]


def flagged_for_deep(papers: DataFrame, chunks: DataFrame, relevances: DataFrame) -> DataFrame:
    """Papers already flagged, with chunk counts and relevances."""
    return candidate_counts(papers.filter("enrichment_status = 'needs_deep_extraction'"), chunks, relevances)


def processing_status(wanted: DataFrame, papers: DataFrame, meta: DataFrame) -> DataFrame:
    """Status of each requested id: not_found, no_pdf, not_extracted or the recorded one."""
    lib = papers.select("id", present("file_path").alias("has_pdf"))
    out = wanted.select("id").join(lib, "id", "left").join(meta.withColumnRenamed("paper_id", "id"), "id", "left")
    status = (F.when(F.col("has_pdf").isNull(), "not_found").when(~F.col("has_pdf"), "no_pdf")
              .when(F.col("chunking_status").isNull(), "not_extracted").otherwise(F.col("chunking_status")))
    needs = (status == "not_extracted") | ((status == "complete") & (F.coalesce("chunk_count", F.lit(0)) == 0))
    return out.select("id", status.alias("status"), needs.alias("needs_extraction"))
