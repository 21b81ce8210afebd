"""Aggregations and reports (A)."""

from pyspark.sql import functions as F

from quire.catalog.listing import DATED, REL_SQL, dated, relevances
from quire.catalog.registry import RAW, query
from quire.operators import ranking, reports, textindex, sketches
from quire.session import top_k

PCT = "round(count(*) FILTER (WHERE {}) * 100.0 / count(*), 1)"


@query("a01_library_stats", f"""
    SELECT CASE WHEN GROUPING(read_status) = 0 THEN 'status' WHEN GROUPING(year) = 0 THEN 'year' ELSE 'total' END AS facet,
           coalesce(read_status, CAST(year AS VARCHAR)) AS value, count(*) AS papers,
           {PCT.format("abstract <> ''")} AS abstract_percent, {PCT.format("doi <> ''")} AS doi_percent,
           round(avg(rating), 2) AS avg_rating
    FROM papers GROUP BY GROUPING SETS ((read_status), (year), ())""", "papers")
def _(t):
    return reports.library_stats(t.papers)


@query("a01_top_years", "SELECT year, count(*) AS papers FROM papers GROUP BY year ORDER BY year DESC LIMIT 10", "papers")
def _(t):
    return reports.top_years(t.papers)


@query("a02_extraction_coverage", """
    WITH f AS (SELECT d.id, d.abstract <> '' AS a, d.id IN (SELECT paper_id FROM chunks) AS c, d.id IN (SELECT paper_id FROM contents) AS e FROM docs d)
    SELECT count(*) AS total, count(*) FILTER (WHERE c) AS with_text, count(*) FILTER (WHERE a) AS with_abstract,
           count(*) FILTER (WHERE e) AS extracted, count(*) FILTER (WHERE (c OR a) AND NOT e) AS needing,
           round(count(*) FILTER (WHERE e) * 100.0 / count(*), 1) AS coverage_percent FROM f""", "docs chunks contents")
def _(t):
    return reports.extraction_coverage(t.docs, t.chunks, t.contents)


NEEDS_SQL = """f AS (SELECT d.id, d.abstract <> '' AS a, d.id IN (SELECT vec_id FROM embeddings) AS v, d.id IN (SELECT paper_id FROM chunks) AS c,
      d.id IN (SELECT paper_id FROM chunks WHERE section = 'system') AS cv FROM docs d)"""


def needs(t):
    ids = t.chunks.filter("section = 'system'").select(
        F.concat_ws("_", F.col("paper_id").cast("string"), F.col("chunk_order").cast("string")).alias("chunk_id"))
    return reports.embedding_needs(t.docs, t.chunks, t.vectors, ids)


@query("a03_embedding_coverage", f"""
    WITH {NEEDS_SQL}
    SELECT count(*) AS total, count(*) FILTER (WHERE v) AS with_vector, count(*) FILTER (WHERE cv) AS with_chunk_vectors,
           count(*) FILTER (WHERE a AND NOT v) AS needing_paper_vector, count(*) FILTER (WHERE c AND NOT cv) AS needing_chunk_vectors,
           round(count(*) FILTER (WHERE v) * 100.0 / count(*), 1) AS coverage_percent FROM f""", "docs chunks")
def _(t):
    return reports.embedding_coverage(needs(t))


@query("a03_embedding_needs", f"""
    WITH {NEEDS_SQL} SELECT id, a AND NOT v AS needs_paper_vector, c AND NOT cv AS needs_chunk_vectors FROM f
    WHERE (a AND NOT v) OR (c AND NOT cv)""", "docs chunks")
def _(t):
    return needs(t).filter("needs_paper_vector OR needs_chunk_vectors").select("id", "needs_paper_vector", "needs_chunk_vectors")


VALIDATED = "CASE status_code WHEN 'F' THEN 'verified' WHEN 'O' THEN 'unvalidated' ELSE CASE WHEN rating = 1 THEN 'error' ELSE 'not_found' END END"
VSTATUS = "CASE read_status WHEN 'read' THEN 'verified' WHEN 'unread' THEN 'unvalidated' ELSE CASE WHEN rating = 1 THEN 'error' ELSE 'not_found' END END"


@query("a04_validation_coverage", f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE s = 'verified') AS verified, count(*) FILTER (WHERE s = 'not_found') AS not_found,
           count(*) FILTER (WHERE s = 'error') AS error, count(*) FILTER (WHERE s = 'unvalidated') AS unvalidated,
           count(doi) AS with_doi, count(arxiv_id) AS with_arxiv, count(*) FILTER (WHERE doi IS NULL AND arxiv_id IS NULL) AS title_only,
           round(count(*) FILTER (WHERE s <> 'unvalidated') * 100.0 / count(*), 1) AS validated_percent
    FROM (SELECT *, {VSTATUS} AS s FROM papers)""", "papers")
def _(t):
    return reports.validation_coverage(t.papers.withColumn("validation_status", F.expr(VSTATUS)))


# processing state: one row per order with lines
META_SQL = """meta AS (SELECT o_orderkey AS paper_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'pending' WHEN '2-HIGH' THEN 'processing'
    WHEN '3-MEDIUM' THEN 'complete' WHEN '5-LOW' THEN 'failed' END AS chunking_status, CAST(o_totalprice / 50000 AS INT) AS chunk_count, o_orderdate AS chunking_queued_at
    FROM orders WHERE o_orderstatus <> 'P'),
  parts AS (SELECT l_orderkey AS paper_id, l_linenumber AS chunk_order, l_returnflag AS content FROM lineitem)"""


def meta(t):
    status = F.expr("""CASE o_orderpriority WHEN '1-URGENT' THEN 'pending' WHEN '2-HIGH' THEN 'processing'
                       WHEN '3-MEDIUM' THEN 'complete' WHEN '5-LOW' THEN 'failed' END""")
    return t.orders.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("paper_id"), status.alias("chunking_status"),
        F.rint(F.col("o_totalprice") / 50000).cast("int").alias("chunk_count"), F.col("o_orderdate").alias("chunking_queued_at"))


def parts(t):
    return t.lineitem.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("chunk_order"),
                             F.col("l_returnflag").alias("content"))


@query("a05_queue_stats", f"""
    WITH {META_SQL}
    SELECT count(*) FILTER (WHERE chunking_status = 'pending') AS pending, count(*) FILTER (WHERE chunking_status = 'processing') AS processing,
           count(*) FILTER (WHERE chunking_status = 'complete') AS complete, count(*) FILTER (WHERE chunking_status = 'failed') AS failed,
           count(*) FILTER (WHERE chunking_status IS NULL) AS none, (SELECT count(file_path) FROM papers) AS total_with_pdf FROM meta""", "papers")
def _(t):
    return reports.queue_stats(t.papers, meta(t))


@query("a06_chunk_stats", f"""
    WITH {META_SQL}
    SELECT (SELECT count(*) FROM papers) AS total, (SELECT count(file_path) FROM papers) AS with_pdf,
           (SELECT count(DISTINCT paper_id) FROM parts) AS with_chunks, (SELECT count(*) FROM parts) AS total_chunks,
           (SELECT count(file_path) FROM papers) - (SELECT count(DISTINCT paper_id) FROM parts) AS need_chunks,
           count(*) FILTER (WHERE chunking_status = 'processing') AS stuck_processing,
           count(*) FILTER (WHERE chunking_status = 'complete' AND paper_id NOT IN (SELECT paper_id FROM parts)) AS stuck_complete_no_chunks
    FROM meta""", "papers")
def _(t):
    return reports.chunk_stats(t.papers, parts(t), meta(t))


@query("a07_tier_stats", f"""
    WITH {REL_SQL}, {DATED},
    f AS (SELECT d.id, d.abstract <> '' AS a, coalesce(x.quick_date IS NOT NULL, FALSE) AS q, coalesce(x.deep_date IS NOT NULL, FALSE) AS dp,
            d.id IN (SELECT paper_id FROM rel WHERE level = 'high') AS h, d.id IN (SELECT paper_id FROM rel WHERE level = 'medium') AS m,
            d.id IN (SELECT paper_id FROM chunks) AS c FROM docs d LEFT JOIN dated x ON x.paper_id = d.id)
    SELECT count(*) AS total, count(*) FILTER (WHERE a) AS with_abstract, count(*) FILTER (WHERE q) AS quick_done, count(*) FILTER (WHERE dp) AS deep_done,
           count(*) FILTER (WHERE a AND NOT q) AS need_quick, count(*) FILTER (WHERE h) AS high_relevance, count(*) FILTER (WHERE m) AS medium_relevance,
           count(*) FILTER (WHERE q AND NOT dp AND (h OR m) AND c) AS ready_for_review,
           count(*) FILTER (WHERE q AND NOT dp AND (h OR m) AND NOT c) AS missing_full_text FROM f""", "docs contents chunks")
def _(t):
    return reports.tier_stats(t.docs, dated(t), t.chunks, relevances(t))


@query("a08_chunk_length_stats", """
    SELECT section, count(*) AS chunks, coalesce(sum(length(content)), 0)::BIGINT AS total_chars, round(avg(length(content)), 4) AS avg_chars,
           min(length(content)) AS min_chars, max(length(content)) AS max_chars FROM chunks GROUP BY ROLLUP (section)""", "chunks")
def _(t):
    return reports.chunk_length_stats(t.chunks, "section")


@query("a10_full_text", "SELECT paper_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_order) AS text, count(*) AS chunks FROM chunks GROUP BY 1", "chunks")
def _(t):
    return reports.full_text(t.chunks)


@query("a11_from_inverted_index", "SELECT doc_id AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS abstract FROM documents")
def _(t):
    # word -> positions map of every document, then the text rebuilt from it
    word = F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("pos", "word")
    index = t.documents.select(F.col("doc_id").alias("id"), word).groupBy("id", "word").agg(F.collect_list("pos").alias("at"))
    index = index.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("inverted_index"))
    return reports.from_inverted_index(index)


@query("a12_collection_counts", """
    SELECT c.id, c.name, (SELECT count(*) FROM paper_collections b WHERE b.collection_id = c.id) AS papers,
           (SELECT count(*) FROM collections k WHERE k.parent_id = c.id) AS children FROM collections c""", "collections paper_collections")
def _(t):
    return reports.collection_counts(t.collections, t.paper_collections).select("id", "name", "papers", "children")


@query("a13_doc_metrics", """
    SELECT paper_id, count(*) AS chunks, sum(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')))::BIGINT AS words,
           sum(length(content))::BIGINT AS chars FROM chunks GROUP BY paper_id""", "chunks")
def _(t):
    return reports.doc_metrics(t.chunks)


@query("a06_sketched_chunks", """
    SELECT section, count(*) AS n, count(DISTINCT paper_id) AS papers, TRUE AS papers_within, TRUE AS median_within, TRUE AS merged_equals_whole FROM chunks GROUP BY section""", "chunks")
def _(t):
    # sketches of sixteen buckets, merged; beside them the exact figures and whether the stated errors hold (four deviations)
    rows = t.chunks.withColumn("chars", F.length("content").cast("double"))
    how = dict(distinct=["paper_id"], measures=["chars"])
    parts = sketches.sketch(rows.withColumn("bucket", F.pmod(F.xxhash64("paper_id"), F.lit(16))), ["section", "bucket"], **how)
    merged = sketches.estimates(sketches.merge(parts, ["section"]), [0.5])
    whole = sketches.estimates(sketches.sketch(rows, ["section"], **how), [0.5]).select("section", F.col("distinct_paper_id").alias("whole"))
    exact = rows.groupBy("section").agg(F.count_distinct("paper_id").alias("papers"), F.percentile("chars", F.lit([0.44, 0.56])).alias("around"))
    both = merged.join(exact, "section").join(whole, "section")
    return both.select("section", "n", "papers", (F.abs(F.col("distinct_paper_id") - F.col("papers")) <= 4 * 0.016 * F.col("papers") + 1).alias("papers_within"),
                       F.col("chars_p50").between(F.col("around")[0], F.col("around")[1]).alias("median_within"), (F.col("distinct_paper_id") == F.col("whole")).alias("merged_equals_whole"))


@query("a14_verification_summary", """
    SELECT count(*) AS verified, count(*) FILTER (WHERE routing = 'accept') AS accepted, count(*) FILTER (WHERE routing IN ('review', 'reextract')) AS needs_review,
           round(avg(score), 2) AS avg_score, count(error) AS errors
    FROM (SELECT 1 - l_discount * 4 AS score, CASE WHEN l_discount <= 0.0375 THEN 'accept' ELSE 'review' END AS routing, CASE WHEN l_tax > 0.07 THEN 'late' END AS error FROM lineitem)""")
def _(t):
    return reports.verification_summary(t.lineitem.select(
        (1 - F.col("l_discount") * 4).alias("score"), F.when(F.col("l_discount") <= 0.0375, "accept").otherwise("review").alias("routing"),
        F.when(F.col("l_tax") > 0.07, "late").alias("error")))


RERANK_SQL = """
    WITH h AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, max(l_extendedprice) AS score, max(l_quantity) AS pair_score FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS original_rank FROM h),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pair_score DESC, original_rank) AS new_rank FROM r)"""


def reranked(t, k=None):
    h = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(
        F.max("l_extendedprice").alias("score"), F.max("l_quantity").alias("pair_score"))
    hits = ranking.ranked(h.drop("pair_score"), ["query_id"], [F.desc("score"), F.col("doc_id")])
    return ranking.rerank(hits, h.select("query_id", "doc_id", "pair_score"), k)


@query("a15_rerank_summary", RERANK_SQL + """
    SELECT query_id, count(*) AS results, round(avg(original_rank - new_rank), 6) AS avg_rank_change, max(original_rank - new_rank) AS max_promotion,
           min(original_rank - new_rank) AS max_demotion FROM n GROUP BY query_id""")
def _(t):
    return reports.rerank_summary(reranked(t))


@query("r17_rerank", RERANK_SQL + """
    SELECT query_id, doc_id, pair_score AS rerank_score, original_rank, new_rank FROM n WHERE new_rank <= 5""")
def _(t):
    return reranked(t, 5).select("query_id", "doc_id", "rerank_score", "original_rank", "new_rank")


@query("a16_table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in RAW))
def _(t):
    return reports.table_counts({n: getattr(t, n) for n in RAW})


@query("a17_search_health", """
    WITH f AS (SELECT count(*) AS n, count(*) FILTER (WHERE len(regexp_extract_all(lower(abstract), '([\\p{L}\\p{N}]+)', 1)) > 0) AS i,
         count(*) FILTER (WHERE id IN (SELECT vec_id FROM embeddings)) AS v, count(*) FILTER (WHERE id IN (SELECT paper_id FROM chunks)) AS c FROM docs),
    g AS (SELECT *, round(v * 100.0 / n, 1) AS p FROM f)
    SELECT n AS total_papers, i AS indexed, v AS with_vector, c AS with_text, p AS coverage_percent,
           concat_ws(' | ', CASE WHEN i <> n THEN 'text index out of sync: ' || i || ' indexed, ' || n || ' total papers' END,
                     CASE WHEN p < 50 THEN 'low vector coverage (' || p || '%)' END) AS warnings,
           concat_ws(' | ', CASE WHEN i <> n THEN 'rebuild the text index' END, CASE WHEN v < n THEN 'embed ' || (n - v) || ' papers' END,
                     CASE WHEN c < n * 0.5 THEN (n - c) || ' papers missing full text' END) AS recommendations,
           CASE WHEN i <> n OR p < 50 THEN 'degraded' ELSE 'healthy' END AS status FROM g""", "docs chunks")
def _(t):
    indexed = textindex.tokenised(t.docs, {"abstract": 5.0}).filter(F.size("tokens") > 0).select(F.col("doc_id").alias("paper_id"))
    out = reports.search_health(t.docs, indexed, t.vectors.select(F.col("id").alias("paper_id")), t.chunks)
    return out.withColumn("warnings", F.array_join("warnings", " | ")).withColumn("recommendations", F.array_join("recommendations", " | "))


@query("a18_validation_outcomes", """
    SELECT s AS status, count(*) AS papers, coalesce((SELECT string_agg(m, ',' ORDER BY id) FROM (
             SELECT e.event_id AS id, e.props AS m FROM events e WHERE e.event_type = x.s ORDER BY 1 LIMIT 10)), '') AS messages
    FROM (SELECT event_type AS s FROM events) x GROUP BY s""")
def _(t):
    out = reports.validation_outcomes(t.events.select(
        F.col("event_id").alias("paper_id"), F.col("event_type").alias("status"), F.col("props").alias("message")))
    return out.select("status", "papers", F.array_join("messages", ",").alias("messages"))


@query("a19_by_source", """
    SELECT source, id, rank, CASE WHEN length(a) > 200 THEN substring(a, 1, 200) || '...' ELSE a END AS abstract FROM (
      SELECT source, id, trim(regexp_replace(abstract, '\\s+', ' ', 'g')) AS a, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, id) AS rank FROM docs) WHERE rank <= 5""", "docs")
def _(t):
    return reports.by_source(t.docs.withColumn("score", F.col("n_chars")), 5).select("source", "id", "rank", "abstract")
