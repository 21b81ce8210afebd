"""Listings, filters, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import shorten, tokens
from quire.session import repeat_per_salt, salt_of, spread, top_k


def list_papers(papers: DataFrame, *, author: str | None = None, tag: str | None = None, year: int | None = None,
                status: str | None = None, paper_authors: DataFrame | None = None, authors: DataFrame | None = None,
                paper_tags: DataFrame | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """F01.  Author and tag filters are semi joins, so a paper never repeats and pages never overlap."""
    out = papers
    if author is not None:
        hits = paper_authors.join(authors.filter(F.col("name").ilike(f"%{author}%")),
                                  paper_authors.author_id == authors.id, "left_semi")
        out = out.join(hits, out.id == hits.paper_id, "left_semi")
    if tag is not None:
        out = out.join(paper_tags.filter(F.col("tag") == tag), F.col("id") == F.col("paper_id"), "left_semi")
    if year is not None:
        out = out.filter(F.col("year") == year)
    if status is not None:
        out = out.filter(F.col("read_status") == status)
    if limit is None and not offset:
        return out
    out = out.orderBy(F.desc("date_added"), F.desc("id")).offset(offset)
    return out if limit is None else out.limit(limit)


def papers_by_author(papers: DataFrame, paper_authors: DataFrame, authors: DataFrame, names: DataFrame,
                     k: int | None = None) -> DataFrame:
    """F02 for a table of ``name`` searches: papers of every author whose name contains it."""
    hit = authors.select(F.col("id").alias("author_id"), F.col("name").alias("author"), F.lower("name").alias("_text"))
    hit = substring_join(hit, names.withColumn("_query", F.lower("name")), "author_id").drop("_text", "_query")
    ids = paper_authors.join(hit, "author_id").select("name", "paper_id").distinct()
    out = ids.join(papers, F.col("paper_id") == papers.id).drop("paper_id")
    return out if k is None else top_k(out, ["name"], [F.desc_nulls_last("year"), F.col("id")], k, "rank")


def papers_by_tag(papers: DataFrame, paper_tags: DataFrame, tags: DataFrame, *, exact: bool = True,
                  k: int | None = None) -> DataFrame:
    """F03 for a table of ``wanted`` tags, equal or contained."""
    known = paper_tags.select("tag").distinct()
    if exact:
        names = known.join(tags, F.col("tag") == F.col("wanted"))
    else:
        names = substring_join(known.withColumn("_text", F.lower("tag")), tags.withColumn("_query", F.lower("wanted")), "tag").drop("_text", "_query")
    ids = paper_tags.join(names, "tag").select("wanted", "paper_id").distinct()
    out = ids.join(papers, F.col("paper_id") == papers.id).drop("paper_id")
    return out if k is None else top_k(out, ["wanted"], [F.desc_nulls_last("year"), F.col("id")], k, "rank")


def lookup(papers: DataFrame, wanted: DataFrame, key: str = "doi") -> DataFrame:
    """every requested key in its input order, with a message where nothing was found."""
    found = papers.select(F.col(key).alias("_key"), F.col("id").alias("paper_id"), "title")
    out = wanted.join(found, wanted[key] == F.col("_key"), "left").drop("_key")
    return out.withColumn("error", F.when(F.col("paper_id").isNull(), F.lit("Paper not found")))


def substring_join(rows: DataFrame, queries: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose ``_text`` contains the ``_query`` of a row of ``queries``, anywhere and of any length.

    A query is looked up under its rarest run of three characters (all of it where shorter)
    among the runs that the texts hold; only texts with that run are searched.
    """
    def runs(c, n):  # distinct runs of n characters
        return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))))

    none = F.array().cast("array<string>")
    ask = queries.select("_query").distinct()
    sizes = sorted(r[0] for r in ask.select(F.least(F.length("_query"), F.lit(3))).distinct().collect())  # at most four numbers
    if not sizes:
        return rows.filter("false").join(queries.filter("false"), F.lit(True)).select(*rows.columns, *queries.columns)
    every = F.concat(*[F.coalesce(runs("_text", n), none) if n else F.array(F.lit("")) for n in sizes])
    own = F.coalesce(*[runs("_query", n) for n in (3, 2, 1)], F.array(F.lit("")))
    ask = ask.select("_query", F.explode(own).alias("_run"))
    held = rows.filter("_text IS NOT NULL").select(key, F.explode(every).alias("_run")).join(ask.select("_run").distinct(), "_run", "left_semi").distinct()
    rare = held.groupBy("_run").agg(F.count("*").alias("n"))
    pick = ask.join(rare, "_run").groupBy("_query").agg(F.min(F.struct("n", "_run")).alias("m")).select("_query", F.col("m._run").alias("_run"))
    cand = held.withColumn("salt", salt_of(key)).join(repeat_per_salt(pick), ["_run", "salt"]).select(key, "_query")
    hit = cand.join(rows, key).filter(F.contains("_text", F.col("_query")))
    return hit.join(queries, "_query").select(*rows.columns, *queries.columns)


def contains_join(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``_text`` contains the ``_query`` of a row of ``queries``.

    A query of three tokens or more pins its inner tokens to whole tokens of the text, so
    its longest inner token is an equality key and only texts with that token are searched.
    Shorter queries have no such token and are looked up by their characters.
    """
    inner = tokens("_query")
    q = queries.withColumn("_inner", F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))))
    keyed = q.filter(F.size("_inner") > 0).withColumn("_key", F.array_max(F.transform(
        "_inner", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]).drop("_inner")
    keys = keyed.select("_key").distinct()
    places = docs.select("id", F.explode(F.array_distinct(tokens("_text"))).alias("_key")).join(keys, "_key", "left_semi")
    cand = places.withColumn("salt", salt_of("id")).join(repeat_per_salt(keyed.select("query_id", "_query", "_key")), ["_key", "salt"])
    cand = cand.select("id", "query_id", "_query").join(docs, "id").filter(F.contains("_text", F.col("_query")))
    cand = cand.drop("_query").join(queries, "query_id")
    short = substring_join(docs, q.filter(F.size("_inner") == 0).drop("_inner"))
    return cand.select(*docs.columns, *queries.columns).unionByName(short.select(*docs.columns, *queries.columns))


def keyword_like(papers: DataFrame, queries: DataFrame, *, year_min: int | None = None, year_max: int | None = None,
                 k: int | None = 20) -> DataFrame:
    """title or abstract contains the query, newest first."""
    docs = papers
    if year_min is not None:
        docs = docs.filter(F.col("year") >= year_min)
    if year_max is not None:
        docs = docs.filter(F.col("year") <= year_max)
    text = F.lower(F.concat_ws("\u0001", "title", "abstract")).alias("_text")
    docs = spread(docs, "id").select("id", "year", text)
    hits = contains_join(docs, queries.select("query_id", F.lower("query").alias("_query"))).drop("_text", "_query")
    best = top_k(hits, ["query_id"], [F.desc_nulls_last("year"), F.col("id")], k, "rank").drop("year")
    return best.join(papers, "id").join(queries, "query_id")


def to_result(papers: DataFrame, score: Column | None = None) -> DataFrame:
    """display row; abstract shortened to 200 characters, score to three decimals."""
    out = papers.withColumn("abstract", shorten("abstract", 200))
    return out if score is None else out.withColumn("score", F.round(score, 3))


def reading_queue(papers: DataFrame, *, min_rating: int | None = None, tag: str | None = None,
                  paper_tags: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """unread papers, best rated first (unrated last), newest first."""
    out = list_papers(papers, status="unread", tag=tag, paper_tags=paper_tags)
    if min_rating is not None:
        out = out.filter(F.col("rating") >= min_rating)
    out = out.orderBy(F.desc_nulls_last("rating"), F.desc("date_added"), F.desc("id"))
    return out if limit is None else out.limit(limit)


def favourites(papers: DataFrame, min_rating: int = 4) -> DataFrame:
    """rated papers at or above the bar."""
    return papers.filter(F.coalesce("rating", F.lit(0)) >= min_rating)


def recent(papers: DataFrame, limit: int = 20) -> DataFrame:
    """most recently added."""
    return papers.orderBy(F.desc("date_added"), F.desc("id")).limit(limit)


def author_label(authors: Column) -> Column:
    """up to three names, then "et al."."""
    names = F.array_join(F.slice(authors, 1, 3), ", ")
    return F.when(F.size(authors) > 3, F.concat(names, F.lit(" et al."))).otherwise(names)


def list_notes(notes: DataFrame, *, paper_id: int | None = None, note_type: str | None = None, offset: int = 0,
               limit: int | None = None) -> DataFrame:
    """notes of a paper and/or type, newest first, paged."""
    out = notes
    if paper_id is not None:
        out = out.filter(F.col("paper_id") == paper_id)
    if note_type is not None:
        out = out.filter(F.col("note_type") == note_type)
    out = out.orderBy(F.desc("created_at"), F.desc("id")).offset(offset)
    return out if limit is None else out.limit(limit)


def pdf_status(papers: DataFrame) -> DataFrame:
    """availability class of every paper."""
    known = F.col("doi").isNotNull() | F.col("arxiv_id").isNotNull()
    return papers.withColumn(
        "pdf_status",
        F.when(F.col("file_path").isNotNull(), "has_pdf").when(known, "needs_pdf").otherwise("no_identifier"),
    )


def references(refs: DataFrame, status: str | None = None) -> DataFrame:
    """parsed references in printed order; display text cut at 200."""
    out = refs if status is None else refs.filter(F.col("match_status") == status)
    return out.withColumn("raw_text", shorten("raw_text", 200))
