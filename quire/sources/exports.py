"""Exports: JSON, CSV, bibliographies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.operators.enrich import with_authors_tags
from quire.sources.bibtex import bibtex_text


def json_rows(papers: DataFrame, paper_authors: DataFrame, authors: DataFrame, paper_tags: DataFrame,
              notes: DataFrame | None = None) -> DataFrame:
    """Papers with nested authors, tags and, if given, notes."""
    out = with_authors_tags(papers, paper_authors, authors, paper_tags)
    if notes is not None:
        n = notes.groupBy(F.col("paper_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(
            F.col("id").alias("note_id"), "note_type", "content"))).alias("notes"))
        out = out.join(n, "id", "left")
    return out


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def csv_rows(papers: DataFrame) -> DataFrame:
    """Six columns, authors joined by a semicolon."""
    return papers.select("id", "title", F.array_join("authors", "; ").alias("authors"), "year", "journal", "doi")


def export_csv(papers: DataFrame, path: str) -> None:
    csv_rows(papers).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def reference_text(papers: DataFrame, style: str) -> DataFrame:
    """One formatted reference per paper (apa, mla, chicago), missing parts left out."""
    part = lambda before, c, after: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "",
                                           F.concat(F.lit(before), F.col(c).cast("string"), F.lit(after)))
    who = F.when(F.size("authors") > 0, F.array_join("authors", ", ")).otherwise(F.lit("Unknown"))
    title = F.coalesce("title", F.lit("Untitled"))
    if style == "apa":
        year = F.coalesce(F.col("year").cast("string"), F.lit("n.d."))
        parts = [F.concat(who, F.lit(" ("), year, F.lit("). "), title, F.lit(".")), part("", "journal", "."), part("https://doi.org/", "doi", "")]
    elif style == "mla":
        parts = [F.concat(who, F.lit('. "'), title, F.lit('."')), part("", "journal", ","), part("", "year", ".")]
    elif style == "chicago":
        parts = [F.concat(who, F.lit('. "'), title, F.lit('."')), part("", "journal", ""), part("(", "year", ").")]
    else:
        raise ValueError(f"unknown style: {style}")
    return papers.select("id", F.lower(F.array_join("authors", ", ")).alias("sort_key"), F.concat_ws(" ", *parts).alias("reference"))


def export_bibliography(papers: DataFrame, style: str, path: str) -> None:
    """Written as text, sorted by author string over all files."""
    if style == "bibtex":
        rows = bibtex_text(papers).orderBy("key", "id").select(F.col("bibtex").alias("value"))
    else:
        rows = reference_text(papers, style).orderBy("sort_key", "id").select(F.col("reference").alias("value"))
    rows.write.mode("overwrite").text(path)
