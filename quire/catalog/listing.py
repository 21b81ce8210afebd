"""Listings, result joins and set operations (F, J, X)."""

from pyspark.sql import functions as F

from quire.catalog.registry import query
from quire.operators import enrich, graph, listing, sets
from quire.session import top_k

DAY = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
SQL_DAY = "strftime(date_added, '%Y-%m-%d') AS date_added"


@query("f01_list_papers", f"""
    SELECT id, year, read_status, {SQL_DAY} FROM papers p
    WHERE read_status = 'unread' AND year = 1997
      AND EXISTS (SELECT 1 FROM paper_authors x JOIN authors a ON x.author_id = a.id WHERE x.paper_id = p.id AND a.name ILIKE '%00007%')
      AND EXISTS (SELECT 1 FROM paper_tags t WHERE t.paper_id = p.id AND t.tag = 'Brand#7')
    """, "papers authors paper_authors paper_tags")
def _(t):
    return listing.list_papers(t.papers, author="00007", tag="Brand#7", year=1997, status="unread",
                               paper_authors=t.paper_authors, authors=t.authors, paper_tags=t.paper_tags,
                               ).select("id", "year", "read_status", DAY("date_added"))


@query("f01_list_page", f"""
    SELECT id, {SQL_DAY} FROM papers p
    WHERE EXISTS (SELECT 1 FROM paper_authors x JOIN authors a ON x.author_id = a.id WHERE x.paper_id = p.id AND a.name ILIKE '%supplier%')
    ORDER BY p.date_added DESC, id DESC LIMIT 50 OFFSET 100""", "papers authors paper_authors")
def _(t):
    return listing.list_papers(t.papers, author="supplier", paper_authors=t.paper_authors, authors=t.authors,
                               offset=100, limit=50).select("id", DAY("date_added"))


@query("f02_papers_by_author", """
    SELECT name, id, year, rank FROM (
      SELECT n.s_name AS name, p.id, p.year, row_number() OVER (PARTITION BY n.s_name ORDER BY p.year DESC NULLS LAST, p.id) AS rank
      FROM (SELECT DISTINCT q.s_name, x.paper_id FROM supplier q JOIN authors a ON a.name ILIKE '%' || q.s_name || '%'
            JOIN paper_authors x ON x.author_id = a.id) n JOIN papers p ON p.id = n.paper_id) WHERE rank <= 5""",
       "papers authors paper_authors")
def _(t):
    names = t.supplier.select(F.col("s_name").alias("name"))
    return listing.papers_by_author(t.papers, t.paper_authors, t.authors, names, 5).select("name", "id", "year", "rank")


TAG_SQL = """
    SELECT wanted, id, year, rank FROM (
      SELECT n.wanted, p.id, p.year, row_number() OVER (PARTITION BY n.wanted ORDER BY p.year DESC NULLS LAST, p.id) AS rank
      FROM (SELECT DISTINCT q.wanted, x.paper_id FROM (SELECT DISTINCT p_brand AS wanted FROM part) q
            JOIN paper_tags x ON {on}) n JOIN papers p ON p.id = n.paper_id) WHERE rank <= 10"""


@query("f03_tag_exact", TAG_SQL.format(on="x.tag = q.wanted"), "papers paper_tags")
def _(t):
    return listing.papers_by_tag(t.papers, t.paper_tags, t.part.select(F.col("p_brand").alias("wanted")).distinct(),
                                 k=10).select("wanted", "id", "year", "rank")


@query("f03_tag_contains", TAG_SQL.format(on="x.tag ILIKE '%' || q.wanted || '%'"), "papers paper_tags")
def _(t):
    return listing.papers_by_tag(t.papers, t.paper_tags, t.part.select(F.col("p_brand").alias("wanted")).distinct(),
                                 exact=False, k=10).select("wanted", "id", "year", "rank")


@query("f04_lookup", """
    SELECT w.ordinal, w.doi, coalesce(p.id, -1) AS paper_id, p.title, CASE WHEN p.id IS NULL THEN 'Paper not found' END AS error
    FROM (SELECT c_custkey AS ordinal, '10.1016/C' || c_custkey || '.1997' AS doi FROM customer) w
    LEFT JOIN papers p ON p.doi = w.doi""", "papers")
def _(t):
    wanted = t.customer.select(F.col("c_custkey").alias("ordinal"),
                               F.concat(F.lit("10.1016/C"), F.col("c_custkey").cast("string"), F.lit(".1997")).alias("doi"))
    out = listing.lookup(t.papers, wanted)
    return out.withColumn("paper_id", F.coalesce("paper_id", F.lit(-1)))


@query("f05_keyword_like", """
    SELECT query_id, id, year, rank FROM (
      SELECT q.query_id, d.id, d.year, row_number() OVER (PARTITION BY q.query_id ORDER BY d.year DESC NULLS LAST, d.id) AS rank
      FROM docs d JOIN search_queries q ON contains(lower(d.title || chr(1) || d.abstract), lower(q.query))
      WHERE d.year BETWEEN 1995 AND 2020) WHERE rank <= 20""", "docs search_queries")
def _(t):
    return listing.keyword_like(t.docs, t.search_queries, year_min=1995, year_max=2020).select("query_id", "id", "year", "rank")


@query("f06_result_rows", """
    SELECT id, title, CASE WHEN length(abstract) > 200 THEN substring(abstract, 1, 200) || '...' ELSE abstract END AS abstract,
           round(n_chars / 1000.0, 3) AS score FROM docs""", "docs")
def _(t):
    return listing.to_result(t.docs, F.col("n_chars") / 1000.0).select("id", "title", "abstract", "score")


@query("f07_reading_queue", """
    SELECT id, rating FROM papers p WHERE read_status = 'unread'
      AND EXISTS (SELECT 1 FROM paper_tags t WHERE t.paper_id = p.id AND t.tag = 'Brand#3')
    ORDER BY rating DESC NULLS LAST, p.date_added DESC, id DESC LIMIT 100""", "papers paper_tags")
def _(t):
    return listing.reading_queue(t.papers, tag="Brand#3", paper_tags=t.paper_tags, limit=100).select("id", "rating")


@query("f08_favourites", "SELECT id, rating FROM papers WHERE coalesce(rating, 0) >= 4", "papers")
def _(t):
    return listing.favourites(t.papers).select("id", "rating")


@query("f08_recent", f"SELECT id, {SQL_DAY} FROM papers p ORDER BY p.date_added DESC, id DESC LIMIT 20", "papers")
def _(t):
    return listing.recent(t.papers).select("id", DAY("date_added"))


@query("f08_author_label", """
    SELECT paper_id, CASE WHEN len(n) > 3 THEN array_to_string(n[1:3], ', ') || ' et al.' ELSE array_to_string(n, ', ') END AS label
    FROM (SELECT paper_id, list(name ORDER BY position, name) AS n FROM paper_authors x JOIN authors a ON a.id = x.author_id
          GROUP BY paper_id)""", "authors paper_authors")
def _(t):
    lists = enrich.author_lists(t.paper_authors, t.authors)
    return lists.select("paper_id", listing.author_label(F.col("authors")).alias("label"))


@query("f09_list_notes", """
    SELECT id, paper_id, note_type FROM notes WHERE note_type = 'purchase'
    ORDER BY created_at DESC, id DESC LIMIT 40 OFFSET 20""", "notes")
def _(t):
    return listing.list_notes(t.notes, note_type="purchase", offset=20, limit=40).select("id", "paper_id", "note_type")


@query("f12_top_k", """
    SELECT owner_id, id, rank FROM (SELECT owner_id, id, row_number() OVER (PARTITION BY owner_id ORDER BY date_added DESC, id) AS rank
      FROM papers) WHERE rank <= 3""", "papers")
def _(t):
    return top_k(t.papers, ["owner_id"], [F.desc("date_added"), F.col("id")], 3, "rank").select("owner_id", "id", "rank")


@query("f13_pdf_status", """
    SELECT pdf_status, count(*) AS papers FROM (
      SELECT CASE WHEN file_path IS NOT NULL THEN 'has_pdf' WHEN doi IS NOT NULL OR arxiv_id IS NOT NULL THEN 'needs_pdf'
             ELSE 'no_identifier' END AS pdf_status FROM papers) GROUP BY pdf_status""", "papers")
def _(t):
    return listing.pdf_status(t.papers).groupBy("pdf_status").agg(F.count("*").alias("papers"))


@query("f14_references", "SELECT paper_id, reference_order, reference_id, raw_text FROM refs WHERE match_status = 'matched'", "refs")
def _(t):
    return listing.references(t.refs, "matched").select("paper_id", "reference_order", "reference_id", "raw_text")


# --- joins ---------------------------------------------------------------------------
@query("j01_enrich", """
    SELECT d.id, coalesce(nullif(c.deep_one_sentence_summary, ''), c.one_sentence_summary) AS summary,
           coalesce(nullif(c.deep_paper_type, ''), c.paper_type) AS paper_type
    FROM docs d LEFT JOIN contents c ON c.paper_id = d.id""", "docs contents")
def _(t):
    return enrich.enrich(t.docs.select("id"), t.contents)


@query("j02_authors_tags", """
    SELECT p.id, coalesce(array_to_string(a.n, '; '), '') AS authors, coalesce(array_to_string(g.n, '; '), '') AS tags
    FROM papers p
    LEFT JOIN (SELECT paper_id, list(name ORDER BY position, name) AS n FROM paper_authors x JOIN authors a ON a.id = x.author_id GROUP BY 1) a ON a.paper_id = p.id
    LEFT JOIN (SELECT paper_id, list(tag ORDER BY tag) AS n FROM paper_tags GROUP BY 1) g ON g.paper_id = p.id""",
       "papers authors paper_authors paper_tags")
def _(t):
    out = enrich.with_authors_tags(t.papers.select("id"), t.paper_authors, t.authors, t.paper_tags)
    return out.select("id", F.array_join("authors", "; ").alias("authors"), F.array_join("tags", "; ").alias("tags"))


@query("j03_needing", """
    SELECT id FROM docs WHERE id IN (SELECT vec_id FROM embeddings) AND id NOT IN (SELECT doc_id FROM labels)""", "docs")
def _(t):
    return enrich.needing(t.docs.select("id"), [t.embeddings.withColumnRenamed("vec_id", "paper_id")],
                          [t.labels.withColumnRenamed("doc_id", "paper_id")])


@query("j04_lacking_deep", """
    SELECT id FROM docs LEFT JOIN contents ON paper_id = id WHERE extraction_depth IS NULL OR extraction_depth <> 'comprehensive'""",
       "docs contents")
def _(t):
    return enrich.lacking_deep(t.docs.select("id"), t.contents).select("id")


@query("j05_claims_citing", """
    SELECT m.claim_id, p.p_partkey AS id FROM (
      SELECT DISTINCT l_orderkey AS claim_id, l_partkey FROM lineitem WHERE l_returnflag = 'A') m
    JOIN part p ON p.p_partkey = m.l_partkey""")
def _(t):
    return enrich.claims_citing(graph.claims_of(t.refs), t.part.select(F.col("p_partkey").alias("id")))


@query("j06_claim_links", """
    SELECT paper_id, count(*) AS links, count(matched_paper_id) AS matched, sum(reference_id)::BIGINT AS reference_sum
    FROM refs GROUP BY paper_id""", "refs")
def _(t):
    return enrich.claim_links(graph.claims_of(t.refs)).groupBy("paper_id").agg(
        F.count("*").alias("links"), F.count("matched_paper_id").alias("matched"), F.sum("reference_id").alias("reference_sum"))


@query("j07_flag_in_library", """
    SELECT w.result_id, coalesce(k.library_id, -1) AS library_id, k.library_id IS NOT NULL AS in_library
    FROM (SELECT c_custkey AS result_id, 'https://doi.org/10.1016/c' || c_custkey || '.1998' AS doi FROM customer) w
    LEFT JOIN (SELECT lower(doi) AS d, min(id) AS library_id FROM papers WHERE doi IS NOT NULL GROUP BY 1) k
      ON k.d = replace(w.doi, 'https://doi.org/', '')""", "papers")
def _(t):
    found = t.customer.select(F.col("c_custkey").alias("result_id"), F.concat(
        F.lit("https://doi.org/10.1016/c"), F.col("c_custkey").cast("string"), F.lit(".1998")).alias("doi"))
    return enrich.flag_in_library(found, t.papers).select(
        "result_id", F.coalesce("library_id", F.lit(-1)).alias("library_id"), "in_library")


@query("j08_length_window", """
    WITH d AS (SELECT DISTINCT title, length(title) AS n FROM docs WHERE title <> ''), q AS (SELECT item_id, length(text) AS n FROM benchmark)
    SELECT q.item_id, count(*) AS partners, min(d.n) AS shortest, max(d.n) AS longest FROM q JOIN d
      ON d.n BETWEEN greatest(CAST(trunc(q.n * 0.92 / 1.08) AS INT) - 10, 1) AND CAST(trunc(q.n * 1.08 / 0.92) AS INT) + 10
    GROUP BY q.item_id""", "docs")
def _(t):
    titles = t.docs.filter("title <> ''").select("title").distinct()
    q = t.benchmark.select("item_id", F.col("text").alias("title"))
    out = enrich.length_window_join(q, titles, 0.92)
    return out.groupBy(F.col("a_item_id").alias("item_id")).agg(
        F.count("*").alias("partners"), F.min(F.length("b_title")).alias("shortest"), F.max(F.length("b_title")).alias("longest"))


@query("j09_unmatched_refs", """
    SELECT r.paper_id, r.reference_id, r.parse_confidence, p.title AS source_title FROM refs r JOIN papers p ON p.id = r.paper_id
    WHERE r.match_status = 'unmatched' AND r.parsed_doi IS NOT NULL""", "refs papers")
def _(t):
    return enrich.unmatched_refs(t.refs, t.papers, doi_only=True).select(
        "paper_id", "reference_id", "parse_confidence", "source_title")


@query("j10_candidate_counts", """
    SELECT d.id, coalesce(c.n, 0) AS chunk_count, r.levels FROM docs d
    LEFT JOIN (SELECT paper_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.paper_id = d.id
    LEFT JOIN (SELECT paper_id, string_agg(project || '=' || level, ',' ORDER BY project) AS levels FROM (
       SELECT doc_id AS paper_id, 'quality' AS project, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS level FROM labels
       UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN 'medium' ELSE 'low' END FROM labels) GROUP BY 1) r ON r.paper_id = d.id""",
       "docs chunks")
def _(t):
    out = enrich.candidate_counts(t.docs.select("id"), t.chunks, relevances(t))
    entries = F.array_sort(F.transform(F.map_entries("relevances"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select("id", "chunk_count", F.array_join(entries, ",").alias("levels"))


def relevances(t):
    """Labels as project relevances."""
    pick = lambda project, yes, level: t.labels.select(
        F.col("doc_id").alias("paper_id"), F.lit(project).alias("project"),
        F.when(F.col(yes) == 1, level).otherwise("low").alias("level"))
    return pick("quality", "quality", "high").unionByName(pick("toxic", "toxic", "medium"))


REL_SQL = """rel AS (SELECT doc_id AS paper_id, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS level FROM labels
             UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'medium' ELSE 'low' END FROM labels)"""
DATED = "dated AS (SELECT *, CASE WHEN source <> 'src1' THEN DATE '2024-01-01' END AS quick_date, CASE WHEN quality = 0 THEN DATE '2024-02-01' END AS deep_date FROM contents JOIN docs ON docs.id = contents.paper_id)"


def dated(t):
    """Extraction rows with tier dates taken from source and quality."""
    return t.contents.join(t.docs.select(F.col("id").alias("paper_id"), "source"), "paper_id").withColumn(
        "quick_date", F.when(F.col("source") != "src1", F.lit("2024-01-01").cast("date"))).withColumn(
        "deep_date", F.when(F.col("quality") == 0, F.lit("2024-02-01").cast("date"))).drop("source")


@query("j11_review_candidates", f"""
    WITH {REL_SQL}, {DATED}
    SELECT d.id, (SELECT count(*) FROM chunks c WHERE c.paper_id = d.id) AS chunk_count FROM docs d
    WHERE d.id IN (SELECT paper_id FROM dated WHERE quick_date IS NOT NULL AND deep_date IS NULL)
      AND d.id IN (SELECT paper_id FROM chunks) AND d.id IN (SELECT paper_id FROM rel WHERE level IN ('high', 'medium'))""",
       "docs contents chunks")
def _(t):
    return enrich.review_candidates(t.docs.select("id"), dated(t), t.chunks, relevances(t), ["high", "medium"]).select("id", "chunk_count")


@query("j12_content_view", """
    SELECT event_id AS id, json_extract_string(props, '$.k') AS k,
           CASE WHEN event_type = 'purchase' OR json_extract_string(props, '$.k') IS NOT NULL THEN 'deep' ELSE 'quick' END AS tier
    FROM events""")
def _(t):
    contents = t.events.select(
        F.col("event_id").alias("paper_id"), F.lit(None).cast("string").alias("one_sentence_summary"),
        F.array().cast("array<string>").alias("key_findings"),
        F.when(F.col("event_type") == "purchase", F.col("event_type")).alias("methodology_summary"),
        F.try_parse_json(F.regexp_replace("props", '"k"', '"techniques_used"')).alias("structured_data"))
    out = enrich.content_view(t.events.select(F.col("event_id").alias("id")), contents)
    return out.select("id", F.col("techniques_used").alias("k"), "tier")


# --- set operations ------------------------------------------------------------------
@query("x01_key_presence", """
    SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'missing' WHEN b.k IS NULL THEN 'orphan' ELSE 'both' END AS presence
    FROM (SELECT DISTINCT p_partkey AS k FROM part) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') b ON a.k = b.k""")
def _(t):
    return sets.key_presence(t.part.select(F.col("p_partkey").alias("key")),
                             t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("key")), "key", "orphan", "missing")


@query("x02_sync_check", """
    SELECT coalesce(a.doc_id, b.vec_id) AS id, CASE WHEN b.vec_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'orphaned' ELSE 'both' END AS presence
    FROM (SELECT doc_id FROM labels) a FULL JOIN embeddings b ON a.doc_id = b.vec_id""")
def _(t):
    return sets.sync_check(t.labels.select(F.col("doc_id").alias("id")), t.embeddings.select(F.col("vec_id").alias("id")))


@query("x03_drop_orphans", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def _(t):
    return sets.drop_orphans(t.vectors.select("id", "label"), t.labels.select(F.col("doc_id").alias("id")))


@query("x04_union_needs", """
    SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def _(t):
    d = t.documents.select(F.col("doc_id").alias("id"))
    return sets.union_needs([d.join(t.labels.select(F.col("doc_id").alias("id")), "id", "left_anti"),
                             d.join(t.embeddings.select(F.col("vec_id").alias("id")), "id", "left_anti")])


@query("x05_union_results", """
    SELECT doi, ordinal, src FROM (
      SELECT *, row_number() OVER (PARTITION BY doi ORDER BY n, ordinal) AS r FROM (
        SELECT doi, id AS ordinal, 'read' AS src, 0 AS n FROM papers WHERE read_status = 'read'
        UNION ALL SELECT doi, id, 'unread', 1 FROM papers WHERE read_status = 'unread')) WHERE r = 1 OR doi IS NULL""", "papers")
def _(t):
    part = lambda s: t.papers.filter(F.col("read_status") == s).select("doi", F.col("id").alias("ordinal"), F.lit(s).alias("src"))
    return sets.union_results([part("read"), part("unread")])


@query("x06_collection_members", """
    WITH RECURSIVE c(root_id, id) AS (SELECT id, id FROM collections UNION ALL SELECT c.root_id, k.id FROM c JOIN collections k ON k.parent_id = c.id)
    SELECT DISTINCT c.root_id, b.paper_id FROM c JOIN paper_collections b ON b.collection_id = c.id""",
       "collections paper_collections")
def _(t):
    return sets.collection_members(graph.collection_closure(t.collections), t.paper_collections)


@query("x07_edit_set", """
    WITH added AS (SELECT DISTINCT l_orderkey AS paper_id, l_returnflag AS tag FROM lineitem),
         removed AS (SELECT paper_id, tag FROM paper_tags t JOIN papers p ON p.id = t.paper_id WHERE p.read_status = 'read')
    SELECT paper_id, tag FROM (SELECT * FROM paper_tags UNION SELECT * FROM added) u
    WHERE NOT EXISTS (SELECT 1 FROM removed r WHERE r.paper_id = u.paper_id AND r.tag = u.tag)""", "paper_tags papers")
def _(t):
    add = t.lineitem.select(F.col("l_orderkey").alias("paper_id"), F.col("l_returnflag").alias("tag"))
    gone = t.paper_tags.join(t.papers.filter("read_status = 'read'"), F.col("paper_id") == F.col("id"), "left_semi")
    return sets.edit_set(t.paper_tags, add, gone, ["paper_id", "tag"])


@query("x07_edit_report", """
    SELECT q.paper_id, q.tag, CASE WHEN t.tag IS NULL THEN 'added' ELSE 'skipped' END AS outcome
    FROM (SELECT DISTINCT o_orderkey AS paper_id, 'Brand#5' AS tag FROM orders) q
    LEFT JOIN paper_tags t ON t.paper_id = q.paper_id AND t.tag = q.tag""", "paper_tags")
def _(t):
    want = t.orders.select(F.col("o_orderkey").alias("paper_id"), F.lit("Brand#5").alias("tag"))
    return sets.edit_report(t.paper_tags, want, ["paper_id", "tag"])
