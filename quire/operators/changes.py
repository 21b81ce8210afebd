"""Bulk changes as new table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quire.functions.text import current_status, doi_key, jaccard
from quire.operators.reports import flagged, present
from quire.operators.sets import first_per_key


def upsert_dim(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Dimension (id, name) with unknown names added under new ids.

    New ids are dense: names are numbered inside one of 4096 hash buckets and shifted by
    the counts of the buckets before, so no task numbers them all.
    """
    names = incoming.select(F.trim("name").alias("name")).filter("name <> ''").distinct()
    new = names.join(existing.select("name"), "name", "left_anti")
    new = new.withColumn("_b", F.pmod(F.xxhash64("name"), F.lit(4096)))
    sizes = new.groupBy("_b").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    new = new.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("name"))).join(offsets, "_b")
    top = F.coalesce(existing.agg(F.max("id").alias("m")).scalar(), F.lit(0))
    new = new.select((top + F.coalesce("_before", F.lit(0)) + F.col("_r")).cast("long").alias("id"), "name")
    return existing.select("id", "name").unionByName(new)


def bridge_rows(dim: DataFrame, incoming: DataFrame) -> DataFrame:
    """(paper_id, author_id, position) of incoming (paper_id, name, position) rows, first position per name."""
    rows = incoming.select("paper_id", F.trim("name").alias("name"), "position").join(dim, "name")
    return rows.groupBy("paper_id", F.col("id").alias("author_id")).agg(F.min("position").alias("position"))


def apply_changes(papers: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Non-null fields of the change win; flags say what has to be redone."""
    new = changes.select("id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_c"))
    out = papers.join(new, "id", "left")
    moved = lambda f: (F.col(f"_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}"))) if f in fields else F.lit(False)
    out = out.withColumn("reembed", moved("title") | moved("abstract")).withColumn("rechunk", moved("file_path"))
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"_{f}", f))
    return out.withColumn("changed", F.col("_c").isNotNull()).drop("_c", *[f"_{f}" for f in fields])


def delete_papers(tables: dict[str, DataFrame], ids: DataFrame, *, links: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Papers gone from every table by ``paper_id`` (``id`` in papers); link columns are set to NULL."""
    gone = ids.select("id").distinct()
    out = {}
    for name, t in tables.items():
        key = "id" if name == "papers" else "paper_id"
        kept = t.join(gone.withColumnRenamed("id", key), key, "left_anti")
        link = (links or {}).get(name)
        if link:
            g = gone.select(F.col("id").alias(link), F.lit(True).alias("_gone"))
            kept = kept.join(g, link, "left").withColumn(link, F.when(F.col("_gone").isNull(), F.col(link))).drop("_gone")
        out[name] = kept.select(*t.columns)
    return out


def import_entries(entries: DataFrame, papers: DataFrame) -> DataFrame:
    """Outcome per entry: imported, skipped (DOI known or repeated), failed (entry came with an ``error``)."""
    rows = entries.withColumn("_doi", doi_key("doi"))
    broken = F.col("error").isNotNull() if "error" in entries.columns else F.lit(False)
    known = papers.select(doi_key("doi").alias("_doi")).filter("_doi IS NOT NULL").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "_doi", "left").withColumn("_broken", broken)
    fresh = rows.filter("_known IS NULL AND NOT _broken")
    first = first_per_key(fresh.select("ordinal", "_doi"), "_doi", ["ordinal"]).select("ordinal", F.lit(True).alias("_new"))
    out = rows.join(first, "ordinal", "left")
    outcome = F.when(F.col("_broken"), "failed").when(F.col("_new"), "imported").otherwise("skipped")
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown Title"))
    return out.withColumn("outcome", outcome).withColumn("title", title).drop("_doi", "_known", "_new", "_broken")


QUICK = ["paper_type", "topics", "one_sentence_summary"]
DEEP_ONLY = ["key_findings", "methodology_summary"]


def upsert_extractions(contents: DataFrame, incoming: DataFrame) -> DataFrame:
    """Quick results go to the quick columns, deep results to the deep ones; neither overwrites the other.

    ``incoming``: paper_id, tier, extracted_at and the extraction fields.  A deep result
    beside a quick one also stores how far the two agree.
    """
    new = incoming.select("paper_id", "tier", "extracted_at", *[F.col(f).alias(f"_{f}") for f in QUICK + DEEP_ONLY])
    out = contents.join(new, "paper_id", "full_outer")
    quick, deep = F.col("tier") == "quick", F.col("tier") == "deep"
    put = lambda on, f, into: F.coalesce(F.when(on, F.col(f"_{f}")), F.col(into))
    agree = deep & F.col("paper_type").isNotNull() & F.col("_paper_type").isNotNull()
    none = F.array().cast("array<string>")
    same = F.when(agree, F.struct((F.col("paper_type") == F.col("_paper_type")).alias("paper_type_matches"),
                                  jaccard(F.coalesce("topics", none), F.coalesce("_topics", none)).alias("topics_overlap")))
    cols = [put(quick, f, f).alias(f) for f in QUICK] + [put(deep, f, f"deep_{f}").alias(f"deep_{f}") for f in QUICK]
    cols += [put(deep, f, f).alias(f) for f in DEEP_ONLY]
    depth = F.when(deep, "comprehensive").when(quick, "abstract_only").otherwise(F.col("extraction_depth"))
    return out.select(
        "paper_id", *cols, F.coalesce(F.when(quick, F.col("extracted_at")), "quick_date").alias("quick_date"),
        F.coalesce(F.when(deep, F.col("extracted_at")), "deep_date").alias("deep_date"), depth.alias("extraction_depth"), same.alias("agreement"))


def derive_status(papers: DataFrame, chunks: DataFrame, contents: DataFrame) -> DataFrame:
    """Enrichment status from the facts: no file, no chunks, no extraction, complete."""
    f = flagged(papers.select("id", present("file_path").alias("has_pdf")), has_chunks=chunks, extracted=contents)
    status = (F.when(F.col("extracted"), "complete").when(F.col("has_chunks"), "needs_extraction")
              .when(F.col("has_pdf"), "needs_chunking").otherwise("needs_pdf"))
    return f.select("id", status.alias("enrichment_status"))


def reset_stuck(meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """Processing rows, completed rows without chunks and failed rows are pending again, errors cleared."""
    have = chunks.select("paper_id").distinct().withColumn("_has", F.lit(True))
    s = F.col("chunking_status")
    out = meta.join(have, "paper_id", "left")
    reset = (s == "processing") | ((s == "complete") & F.col("_has").isNull())
    again = F.coalesce(reset, F.lit(False)) | F.coalesce(s == "failed", F.lit(False))
    out = out.withColumn("_again", again).withColumn("chunk_count", F.when(F.col("_again"), 0).otherwise(F.col("chunk_count")))
    if "chunking_error" in meta.columns:
        out = out.withColumn("chunking_error", F.when(~F.col("_again"), F.col("chunking_error")))
    return out.withColumn("chunking_status", F.when(F.col("_again"), "pending").otherwise(s)).drop("_has", "_again")


def migrate_status(papers: DataFrame) -> DataFrame:
    """Legacy status names replaced."""
    return papers.withColumn("enrichment_status", current_status("enrichment_status"))


def flag(papers: DataFrame, ids: DataFrame, column: str, value: str | Column) -> tuple[DataFrame, DataFrame]:
    """Papers with the flag set, and the requested ids that do not exist."""
    want = ids.select("id").distinct()
    marked = papers.join(want.withColumn("_f", F.lit(True)), "id", "left")
    v = F.lit(value) if isinstance(value, str) or value is None else value
    marked = marked.withColumn(column, F.when(F.col("_f"), v).otherwise(F.col(column))).drop("_f")
    return marked, want.join(papers.select("id"), "id", "left_anti")
