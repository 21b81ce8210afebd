"""Citation graph (G)."""

from pyspark.sql import functions as F

from quire.catalog.registry import query
from quire.operators import enrich, graph


def parts(t):
    """Parts as cited works."""
    return t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("10.1000/P"), F.col("p_partkey").cast("string")).alias("doi"),
                         F.col("p_name").alias("title"), F.col("p_type").alias("kind"))


@query("g01_citations", """
    SELECT p_partkey AS id, citing AS other_id, 'citing' AS direction FROM part JOIN edges ON cited = p_partkey
    UNION ALL SELECT p_partkey, cited, 'cited' FROM part JOIN edges ON citing = p_partkey""", "edges")
def _(t):
    return graph.citations(t.edges, parts(t).select("id"))


SHARED = """d AS (SELECT DISTINCT paper_id, lower(parsed_doi) AS doi FROM refs),
  s AS (SELECT a.paper_id AS paper_a, b.paper_id AS paper_b, count(*) AS n, list(a.doi ORDER BY a.doi) AS dois FROM d a JOIN d b ON a.doi = b.doi AND a.paper_id < b.paper_id
        GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("g02_common_references", f"WITH {SHARED} SELECT paper_a, paper_b, n AS shared_references, array_to_string(dois[1:5], ',') AS shared_dois FROM s", "refs")
def _(t):
    return graph.common_references(t.refs, 2).withColumn("shared_dois", F.array_join("shared_dois", ","))


@query("g02_related_papers", f"""WITH {SHARED}, b AS (SELECT paper_a AS paper_id, paper_b AS related_id, n FROM s UNION ALL SELECT paper_b, paper_a, n FROM s)
    SELECT paper_id, related_id, n AS shared_references, rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, related_id) AS rank FROM b) WHERE rank <= 10""", "refs")
def _(t):
    return graph.related_papers(graph.common_references(t.refs, 2), 10).drop("shared_dois")


# order lines as links of the order: returned lines cite it, the others are cited by it
LINKS = """links AS (SELECT l_suppkey AS paper_id, CASE WHEN l_returnflag = 'R' THEN 'citation' ELSE 'reference' END AS relation, '10.1000/P' || l_partkey AS doi, l_partkey AS pk FROM lineitem),
  lib AS (SELECT p_partkey AS id, '10.1000/P' || p_partkey AS doi, p_name AS title FROM part WHERE p_type <> 'ECONOMY'),
  seed AS (SELECT s_suppkey AS id FROM supplier),
  far AS (SELECT l.*, b.id AS lid, coalesce('lib_' || b.id, 'ext_' || l.doi) AS node FROM links l LEFT JOIN lib b ON lower(b.doi) = lower(l.doi)),
  f1 AS (SELECT * FROM far WHERE paper_id IN (SELECT id FROM seed)),
  f2 AS (SELECT * FROM far WHERE paper_id IN (SELECT lid FROM f1 WHERE lid IS NOT NULL)),
  reached AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2)"""


def graph_of(t):
    links = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("paper_id"), F.when(F.col("l_returnflag") == "R", "citation").otherwise("reference").alias("relation"),
        F.concat(F.lit("10.1000/P"), F.col("l_partkey").cast("string")).alias("doi"), F.col("p_name").alias("title"), F.lit(2000).alias("year"))
    return graph.build_graph(t.supplier.select(F.col("s_suppkey").alias("id")), links, parts(t).filter("kind <> 'ECONOMY'"),
                             include_external=True, depth=2)


@query("g03_graph_nodes", f"""WITH {LINKS}
    SELECT 'lib_' || id AS node, substring(title, 1, 50) AS label, 'library' AS type FROM lib WHERE id IN (SELECT id FROM seed) OR id IN (SELECT lid FROM reached WHERE lid IS NOT NULL)
    UNION ALL SELECT node, substring(min(p_name), 1, 50), 'external' FROM reached JOIN part ON p_partkey = pk WHERE lid IS NULL GROUP BY node""")
def _(t):
    return graph_of(t)[0]


@query("g03_graph_edges", f"""WITH {LINKS}
    SELECT DISTINCT CASE WHEN relation = 'reference' THEN 'lib_' || paper_id ELSE node END AS source,
           CASE WHEN relation = 'reference' THEN node ELSE 'lib_' || paper_id END AS target, 'cites' AS type FROM reached""")
def _(t):
    return graph_of(t)[1]


@query("g04_add_edges", """
    SELECT DISTINCT e.cited AS citing, e.citing AS cited FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.citing = e.cited AND x.cited = e.citing)""", "edges")
def _(t):
    return graph.add_edges(t.edges, t.edges.select(F.col("cited").alias("citing"), F.col("citing").alias("cited")))


@query("g05_harvest_plan", """
    WITH r AS (SELECT l_suppkey AS paper_id, l_orderkey * 1000 + l_linenumber * 10 + 0 AS o, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, CAST(extract(year FROM l_shipdate) AS INT) AS year FROM lineitem),
    x AS (SELECT paper_id, l_orderkey * 100000.0 + l_extendedprice AS ordinal, p.p_partkey AS lid FROM r LEFT JOIN (SELECT * FROM part WHERE p_type <> 'ECONOMY') p ON p.p_partkey = r.l_partkey WHERE year >= 1999),
    a AS (SELECT *, CASE WHEN lid IS NOT NULL THEN 'in_library' WHEN row_number() OVER (PARTITION BY paper_id, lid IS NULL ORDER BY ordinal) <= 20 THEN 'import' ELSE 'over_quota' END AS action FROM x)
    SELECT paper_id, action, count(*) AS refs, count(*) FILTER (WHERE lid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.citing = a.paper_id AND e.cited = a.lid)) AS new_edges FROM a GROUP BY 1, 2""", "edges")
def _(t):
    refs = t.lineitem.select(F.col("l_suppkey").alias("paper_id"), (F.col("l_orderkey") * 100000.0 + F.col("l_extendedprice")).alias("ordinal"),
                             F.year("l_shipdate").alias("year"), F.concat(F.lit("10.1000/P"), F.col("l_partkey").cast("string")).alias("doi"))
    plan = graph.harvest_plan(refs, parts(t).filter("kind <> 'ECONOMY'"), t.edges, min_year=1999, max_imports=20)
    return plan.groupBy("paper_id", "action").agg(F.count("*").alias("refs"), F.count_if("new_edge").alias("new_edges"))


@query("g06_claims", """
    SELECT o.o_orderkey AS claim_id, o.o_orderpriority AS importance, coalesce((SELECT string_agg(p_name, ';' ORDER BY l_linenumber, l_partkey, l_suppkey)
      FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'A'), '') AS matched
    FROM orders o WHERE o.o_orderpriority = '1-URGENT' AND o.o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def _(t):
    rows = graph.claims_of(t.refs).join(t.orders.select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("importance")), "claim_id")
    out = graph.claims(rows, parts(t), importance="1-URGENT")
    return out.select("claim_id", "importance", F.coalesce(F.array_join(F.transform("matched_papers", lambda m: m["title"]), ";"), F.lit("")).alias("matched"))


@query("g08_unmatched_claim_refs", """
    SELECT reference_id, min(paper_id) AS claim_id, arg_min(paper_id, paper_id) AS citing_paper_id, (SELECT min(substring(x.raw_text, 1, 200)) FROM refs x WHERE x.reference_id = r.reference_id) AS raw_text
    FROM refs r WHERE match_status = 'unmatched' GROUP BY reference_id""", "refs")
def _(t):
    return graph.unmatched_claim_refs(enrich.claim_links(graph.claims_of(t.refs)), t.refs)


def chain_sql(src, dst):
    return f"""WITH h AS (SELECT DISTINCT {src} AS a, {dst} AS b FROM edges), s AS (SELECT p_partkey AS seed, p_partkey AS id FROM part),
    l1 AS (SELECT DISTINCT seed, b AS id FROM s JOIN h ON h.a = s.id), l2 AS (SELECT DISTINCT l1.seed, h.b AS id FROM l1 JOIN h ON h.a = l1.id)
    SELECT seed AS seed_id, level, count(*) AS papers, sum(id)::BIGINT AS id_sum FROM (SELECT *, 1 AS level FROM l1 UNION ALL SELECT *, 2 FROM l2) GROUP BY 1, 2"""


def per_level(df):
    return df.groupBy("seed_id", "level").agg(F.count("*").alias("papers"), F.sum("paper_id").alias("id_sum"))


@query("g09_chain_forward", chain_sql("citing", "cited"), "edges")
def _(t):
    return per_level(graph.chain(t.edges, parts(t), depth=2))


@query("g09_chain_backward", chain_sql("cited", "citing"), "edges")
def _(t):
    return per_level(graph.chain(t.edges, parts(t), depth=2, direction="backward"))


@query("g09_chain_unvisited", """WITH h AS (SELECT DISTINCT citing AS a, cited AS b FROM edges), s AS (SELECT p_partkey AS seed, p_partkey AS id FROM part),
    l1 AS (SELECT DISTINCT seed, b AS id FROM s JOIN h ON h.a = s.id WHERE b <> seed), l2 AS (SELECT DISTINCT l1.seed, h.b AS id FROM l1 JOIN h ON h.a = l1.id WHERE h.b <> l1.seed),
    n2 AS (SELECT * FROM l2 EXCEPT SELECT * FROM l1)
    SELECT seed AS seed_id, level, count(*) AS papers, sum(id)::BIGINT AS id_sum FROM (SELECT *, 1 AS level FROM l1 UNION ALL SELECT *, 2 FROM n2) GROUP BY 1, 2""", "edges")
def _(t):
    return per_level(graph.chain(t.edges, parts(t), depth=2, visited=True))


@query("g09_chain_deep", """SELECT p.p_partkey AS seed_id, l.level, 1::BIGINT AS papers, q.p_partkey AS id_sum FROM part p, (SELECT unnest(range(1, 6))::INT AS level) l JOIN part q ON q.p_partkey = p.p_partkey + l.level""")
def _(t):
    # one long path: every paper cites the next
    path = parts(t).select(F.col("id").alias("citing"), (F.col("id") + 1).alias("cited"))
    return per_level(graph.chain(path.join(parts(t).select(F.col("id").alias("cited")), "cited", "left_semi"), parts(t), depth=5))


@query("g10_link_claims", """
    WITH c AS (SELECT l_orderkey AS claim_id, l_linenumber AS num, l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O'),
    r AS (SELECT paper_id, reference_order, max(reference_id) AS reference_id, arg_max(matched_paper_id IS NOT NULL, reference_id * 2 + CASE WHEN matched_paper_id IS NOT NULL THEN 1 ELSE 0 END) AS m FROM refs GROUP BY 1, 2),
    j AS (SELECT c.claim_id, c.num, CASE WHEN r.paper_id IS NULL THEN 'reference_not_found' WHEN r.m THEN 'matched' ELSE 'unmatched' END AS s, coalesce(CAST(r.reference_id AS VARCHAR), '-') AS rid
      FROM c LEFT JOIN r ON r.paper_id = c.claim_id AND r.reference_order = c.num - 1)
    SELECT claim_id, string_agg(rid, ',' ORDER BY num) AS reference_ids, string_agg(s, ',' ORDER BY num) AS match_statuses FROM j GROUP BY 1""", "refs")
def _(t):
    rows = t.lineitem.filter("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("claim_id")).agg(
        F.array_sort(F.collect_list("l_linenumber")).alias("citation_numbers")).withColumn("paper_id", F.col("claim_id"))
    out = graph.link_claims(rows, t.refs)
    text = F.transform("reference_ids", lambda r: F.coalesce(r.cast("string"), F.lit("-")))
    return out.select("claim_id", F.array_join(text, ",").alias("reference_ids"), F.array_join("match_statuses", ",").alias("match_statuses"))


@query("g11_collection_closure", """
    WITH RECURSIVE c(root_id, id, depth) AS (SELECT id, id, 0 FROM collections UNION ALL SELECT c.root_id, k.id, c.depth + 1 FROM c JOIN collections k ON k.parent_id = c.id)
    SELECT root_id, id, depth FROM c""", "collections")
def _(t):
    return graph.collection_closure(t.collections)


@query("g11_collection_closure_deep", """
    SELECT a.c_custkey AS root_id, b.c_custkey AS id, CAST(b.c_custkey - a.c_custkey AS INT) AS depth FROM customer a JOIN customer b ON b.c_custkey // 70 = a.c_custkey // 70 AND b.c_custkey >= a.c_custkey""")
def _(t):
    # chains of seventy collections
    c = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 70 > 0, F.col("c_custkey") - 1).alias("parent_id"))
    return graph.collection_closure(c)
