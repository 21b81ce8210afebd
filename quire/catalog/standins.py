"""Library views over the driver tables.

The driver ships no paper library, so each library relation is defined as SQL over its
tables.  The text is plain enough for both engines: Spark runs it with DataFrames bound to
``@name`` and the oracle gets the same definition as a common table expression.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[str, list[str]]] = {
    # orders as papers: status, priority, date and price play status, rating, date, ids
    "papers": ("""
        SELECT o_orderkey AS id, 'Report ' || CAST(o_orderkey AS STRING) || ' ' || o_orderpriority AS title,
               CAST(extract(year FROM o_orderdate) AS INT) AS year,
               CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(substring(o_orderpriority, 1, 1) AS INT) END AS rating,
               CASE o_orderstatus WHEN 'F' THEN 'read' WHEN 'O' THEN 'unread' ELSE 'reading' END AS read_status,
               o_orderdate AS date_added, o_custkey AS owner_id,
               CASE WHEN o_totalprice >= 100000 THEN '10.1016/C' || CAST(o_custkey AS STRING) || '.'
                    || CAST(extract(year FROM o_orderdate) AS STRING) END AS doi,
               CASE WHEN o_totalprice < 150000 THEN '2401.' || CAST(o_orderkey AS STRING) END AS arxiv_id,
               CASE WHEN o_orderstatus = 'F' THEN '/pdf/' || CAST(o_orderkey AS STRING) END AS file_path,
               CASE WHEN o_orderpriority LIKE '5%' THEN '' WHEN o_totalprice >= 30000 THEN 'Abstract of ' || CAST(o_orderkey AS STRING) END AS abstract
        FROM @orders""", ["orders"]),
    "authors": ("SELECT s_suppkey AS id, s_name AS name FROM @supplier", ["supplier"]),
    "paper_authors": ("""
        SELECT l_orderkey AS paper_id, l_suppkey AS author_id, min(l_linenumber) AS position
        FROM @lineitem GROUP BY l_orderkey, l_suppkey""", ["lineitem"]),
    "paper_tags": ("""
        SELECT DISTINCT l_orderkey AS paper_id, p_brand AS tag
        FROM @lineitem JOIN @part ON l_partkey = p_partkey""", ["lineitem", "part"]),
    "notes": ("""
        SELECT event_id AS id, user_id AS paper_id, event_type AS note_type, props AS content, ts AS created_at
        FROM @events""", ["events"]),
    # nations inside regions, customers as members
    "collections": ("""
        SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id FROM @region
        UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 100, n_name, CAST(n_regionkey AS BIGINT) FROM @nation
        """, ["region", "nation"]),
    "paper_collections": ("""
        SELECT CAST(c_nationkey AS BIGINT) + 100 AS collection_id, c_custkey AS paper_id FROM @customer""", ["customer"]),
    # order lines as parsed references
    "refs": ("""
        SELECT l_orderkey AS paper_id, l_linenumber AS reference_order, '10.1000/P' || CAST(l_partkey AS STRING) AS parsed_doi,
               'Part ' || CAST(l_partkey AS STRING) || ' by ' || CAST(l_suppkey AS STRING) AS raw_text, l_partkey AS reference_id,
               CASE l_returnflag WHEN 'A' THEN 'matched' WHEN 'N' THEN 'unmatched' ELSE 'rejected' END AS match_status,
               CASE l_returnflag WHEN 'A' THEN l_partkey END AS matched_paper_id, 1 - l_discount AS parse_confidence
        FROM @lineitem""", ["lineitem"]),
    # consecutive parts of an order as citation edges
    "edges": ("""
        SELECT DISTINCT citing, cited FROM (
          SELECT l_partkey AS citing, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS cited
          FROM @lineitem) e WHERE cited IS NOT NULL AND citing <> cited""", ["lineitem"]),
    # documents as papers with text; the first sentence of the first line is the title
    "docs": ("""
        SELECT doc_id AS id, trim(split_part(split_part(text, chr(10), 1), '.', 1)) AS title, text AS abstract,
               CAST(1990 + (n_chars % 35) AS INT) AS year, lang, source, n_chars
        FROM @documents""", ["documents"]),
    "search_queries": ("SELECT item_id AS query_id, text AS query FROM @benchmark", ["benchmark"]),
    # labelled documents as extraction rows
    "contents": ("""
        SELECT doc_id AS paper_id, CASE WHEN quality = 1 THEN 'comprehensive' ELSE 'abstract_only' END AS extraction_depth,
               CASE WHEN toxic = 0 THEN split_part(text, '.', 1) END AS one_sentence_summary,
               CASE WHEN quality = 1 THEN split_part(text, '.', 2) END AS deep_one_sentence_summary,
               source AS paper_type, CASE WHEN quality = 1 THEN lang END AS deep_paper_type,
               quality, toxic
        FROM @labels JOIN @documents USING (doc_id)""", ["labels", "documents"]),
    "chunks": ("""
        SELECT conv_id AS paper_id, turn AS chunk_order, role AS section, text AS content FROM @conversations""",
               ["conversations"]),
    "vectors": ("SELECT vec_id AS id, embedding, label FROM @embeddings", ["embeddings"]),
}


def expand(sql: str, needs: list[str]) -> str:
    """Oracle text: the views it needs as common table expressions, then the query."""
    ctes = ", ".join(f"{n} AS ({_plain(n)})" for n in needs)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def _plain(name: str) -> str:
    sql, tables = VIEWS[name]
    for t in tables:
        sql = sql.replace(f"@{t}", t)
    return sql.strip()
