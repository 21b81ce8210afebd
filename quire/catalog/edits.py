"""Bulk changes (U)."""

from pyspark.sql import functions as F

from quire.catalog.registry import query
from quire.catalog.reports import META_SQL, meta, parts
from quire.operators import changes


@query("u01_upsert_dim", """
    WITH n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT s_name FROM supplier))
    SELECT count(*) AS names, count(DISTINCT id) AS ids, max(id) AS top FROM (SELECT s_suppkey AS id, s_name FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY name), name FROM n)""")
def _(t):
    out = changes.upsert_dim(t.authors, t.part.select(F.col("p_name").alias("name")))
    return out.agg(F.count("name").alias("names"), F.count_distinct("id").alias("ids"), F.max("id").alias("top"))


@query("u01_bridge_rows", """SELECT l_orderkey AS paper_id, l_suppkey AS author_id, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2""")
def _(t):
    rows = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(
        F.col("l_orderkey").alias("paper_id"), F.concat(F.lit(" "), "s_name").alias("name"), F.col("l_linenumber").alias("position"))
    return changes.bridge_rows(t.authors, rows)


CHANGE = "c AS (SELECT l_orderkey AS id, max(CASE WHEN l_returnflag = 'R' THEN 'New ' || l_orderkey END) AS title, max(CASE WHEN l_returnflag = 'A' THEN '/pdf/' || l_orderkey END) AS file_path FROM lineitem GROUP BY 1)"


@query("u02_apply_changes", f"""WITH {CHANGE}
    SELECT p.id, coalesce(c.title, p.title) AS title, coalesce(c.file_path, p.file_path) AS file_path, c.title IS NOT NULL AS reembed, c.file_path IS NOT NULL AND p.file_path IS DISTINCT FROM c.file_path AS rechunk, c.id IS NOT NULL AS changed
    FROM papers p LEFT JOIN c ON c.id = p.id""", "papers")
def _(t):
    key = F.col("l_orderkey").cast("string")
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.max(F.when(F.col("l_returnflag") == "R", F.concat(F.lit("New "), key))).alias("title"),
        F.max(F.when(F.col("l_returnflag") == "A", F.concat(F.lit("/pdf/"), key))).alias("file_path"))
    return changes.apply_changes(t.papers.select("id", "title", "file_path"), c, ["title", "file_path"])


@query("u03_delete_papers", """
    SELECT 'papers' AS relation, count(*) AS rows, 0 AS unlinked FROM papers WHERE read_status <> 'reading'
    UNION ALL SELECT 'authors', count(*), 0 FROM paper_authors WHERE paper_id NOT IN (SELECT id FROM papers WHERE read_status = 'reading')
    UNION ALL SELECT 'refs', count(*), count(*) FILTER (WHERE matched_paper_id IS NULL OR matched_paper_id IN (SELECT id FROM papers WHERE read_status = 'reading')) FROM refs WHERE paper_id NOT IN (SELECT id FROM papers WHERE read_status = 'reading')""",
       "papers paper_authors refs")
def _(t):
    out = changes.delete_papers({"papers": t.papers, "authors": t.paper_authors, "refs": t.refs}, t.papers.filter("read_status = 'reading'"),
                                links={"refs": "matched_paper_id"})
    n = lambda name, gone: out[name].agg(F.lit(name).alias("relation"), F.count("*").alias("rows"), gone.alias("unlinked"))
    zero = F.lit(0).cast("long")
    return n("papers", zero).unionByName(n("authors", zero)).unionByName(n("refs", F.count_if(F.col("matched_paper_id").isNull())))


@query("u04_import_entries", """
    WITH e AS (SELECT id AS ordinal, doi, CASE WHEN rating IS NULL THEN 'bad' END AS error FROM papers WHERE read_status <> 'read'),
    k AS (SELECT DISTINCT doi FROM papers WHERE read_status = 'read'), f AS (SELECT *, doi IN (SELECT doi FROM k WHERE doi IS NOT NULL) AS known FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY doi, error IS NULL AND coalesce(known, FALSE) = FALSE ORDER BY ordinal) AS r FROM f)
    SELECT ordinal, CASE WHEN error IS NOT NULL THEN 'failed' WHEN doi IS NULL THEN 'imported' WHEN known OR r > 1 THEN 'skipped' ELSE 'imported' END AS outcome FROM n""", "papers")
def _(t):
    e = t.papers.filter("read_status <> 'read'").select(F.col("id").alias("ordinal"), "doi", "title", F.when(F.col("rating").isNull(), "bad").alias("error"))
    return changes.import_entries(e, t.papers.filter("read_status = 'read'")).select("ordinal", "outcome")


def quick_rows(t):
    base = t.contents.select(
        "paper_id", F.when(F.col("quality") == 1, F.col("paper_type")).alias("paper_type"), F.array("deep_paper_type").alias("topics"), "one_sentence_summary",
        F.lit(None).cast("string").alias("deep_paper_type"), F.array().cast("array<string>").alias("deep_topics"), F.lit(None).cast("string").alias("deep_one_sentence_summary"),
        F.array().cast("array<string>").alias("key_findings"), F.lit(None).cast("string").alias("methodology_summary"),
        F.lit("2024-01-01").cast("date").alias("quick_date"), F.lit(None).cast("date").alias("deep_date"), "extraction_depth")
    new = t.documents.select(
        F.col("doc_id").alias("paper_id"), F.when(F.col("lang") == "en", "deep").otherwise("quick").alias("tier"), F.lit("2024-06-01").cast("date").alias("extracted_at"),
        F.col("source").alias("paper_type"), F.array("lang").alias("topics"), F.split_part("text", F.lit("."), F.lit(1)).alias("one_sentence_summary"),
        F.array(F.col("source")).alias("key_findings"), F.col("lang").alias("methodology_summary"))
    return base, new


@query("u05_upsert_extractions", """
    SELECT d.doc_id AS paper_id, CASE WHEN d.lang <> 'en' THEN d.source WHEN l.quality = 1 THEN d.source END AS paper_type, CASE WHEN d.lang = 'en' THEN d.source END AS deep_paper_type,
      CASE WHEN d.lang = 'en' THEN 'comprehensive' ELSE 'abstract_only' END AS extraction_depth, CASE WHEN d.lang = 'en' THEN d.lang END AS methodology_summary,
      CASE WHEN d.lang = 'en' AND l.quality = 1 THEN 1.0 END AS topics_overlap, d.lang = 'en' AS has_deep
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(t):
    out = changes.upsert_extractions(*quick_rows(t))
    return out.select("paper_id", "paper_type", "deep_paper_type", "extraction_depth", "methodology_summary", F.col("agreement.topics_overlap").alias("topics_overlap"),
                      F.col("deep_date").isNotNull().alias("has_deep"))


@query("u06_derive_status", """
    SELECT CASE WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'complete' WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') THEN 'needs_extraction'
      WHEN file_path IS NOT NULL THEN 'needs_chunking' ELSE 'needs_pdf' END AS enrichment_status, count(*) AS papers FROM papers GROUP BY 1""", "papers")
def _(t):
    ids = lambda cond: t.lineitem.filter(cond).select(F.col("l_orderkey").alias("paper_id"))
    out = changes.derive_status(t.papers, ids("l_linestatus = 'F'"), ids("l_returnflag = 'R'"))
    return out.groupBy("enrichment_status").agg(F.count("*").alias("papers"))


@query("u06_reset_stuck", f"""WITH {META_SQL}, r AS (SELECT *, coalesce(chunking_status IN ('processing', 'failed') OR (chunking_status = 'complete' AND paper_id NOT IN (SELECT paper_id FROM parts)), FALSE) AS again FROM meta)
    SELECT paper_id, CASE WHEN again THEN 'pending' ELSE chunking_status END AS chunking_status, CASE WHEN again THEN 0 ELSE chunk_count END AS chunk_count FROM r""")
def _(t):
    return changes.reset_stuck(meta(t), parts(t)).select("paper_id", "chunking_status", "chunk_count")


@query("u06_migrate_status", "SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'needs_extraction' ELSE event_type END AS enrichment_status FROM events")
def _(t):
    s = F.when(F.col("event_type") == "view", "needs_abstract").otherwise(F.col("event_type"))
    return changes.migrate_status(t.events.select(F.col("event_id").alias("id"), s.alias("enrichment_status")))


@query("u07_flag", """SELECT id, CASE WHEN id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN 'flagged' ELSE read_status END AS read_status FROM papers""", "papers")
def _(t):
    want = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return changes.flag(t.papers.select("id", "read_status"), want, "read_status", "flagged")[0]


@query("u07_flag_not_found", "SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part)")
def _(t):
    return changes.flag(t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("s")), t.orders.select(F.col("o_orderkey").alias("id")), "s", "x")[1]
