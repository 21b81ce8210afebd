"""Scalar functions (N), chunking and structure (C), exports (S)."""

import uuid

from pyspark.sql import functions as F

from quire.catalog.registry import query
from quire.functions import similarity as sim, text as fx
from quire.operators import chunking, enrich, linkage, structure
from quire.sources import bibtex, exports, library, projects, refmanager, tex, vectorstore

JOIN = lambda c, s=",": F.array_join(c, s).alias(c)


@query("n01_clean_query", r"""SELECT item_id, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s\-''"]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM benchmark""")
def _(t):
    return t.benchmark.select("item_id", fx.clean_query("text").alias("q"))


@query("n02_title_plain", r"SELECT id, regexp_replace(lower(trim(title)), '[^\p{L}\p{N}_\s]', '', 'g') AS t FROM docs", "docs")
def _(t):
    return t.docs.select("id", fx.title_plain("title").alias("t"))


@query("n03_title_ascii", r"SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS t FROM docs", "docs")
def _(t):
    return t.docs.select("id", fx.title_ascii("title").alias("t"))


@query("n04_title_key", r"SELECT id, nullif(lower(trim(regexp_replace(title, '\s+', ' ', 'g'))), '') AS t FROM docs", "docs")
def _(t):
    return t.docs.select("id", fx.title_key("title").alias("t"))


# identifiers in several spellings, derived from the orders
DOIS = """v AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'https://doi.org/' WHEN '2-HIGH' THEN 'http://dx.doi.org/' WHEN '3-MEDIUM' THEN 'DOI: ' WHEN '5-LOW' THEN '  ' ELSE '' END
      || CASE o_orderstatus WHEN 'F' THEN '10.1016/X' WHEN 'O' THEN '10.1038/Y' ELSE '10.9999/Z' END || o_custkey AS doi, o_custkey, o_orderstatus FROM orders)"""


def dois(t):
    head = F.expr("""CASE o_orderpriority WHEN '1-URGENT' THEN 'https://doi.org/' WHEN '2-HIGH' THEN 'http://dx.doi.org/' WHEN '3-MEDIUM' THEN 'DOI: '
                     WHEN '5-LOW' THEN '  ' ELSE '' END""")
    body = F.expr("CASE o_orderstatus WHEN 'F' THEN '10.1016/X' WHEN 'O' THEN '10.1038/Y' ELSE '10.9999/Z' END")
    return t.orders.select(F.col("o_orderkey").alias("id"), F.concat(head, body, F.col("o_custkey").cast("string")).alias("doi"))


@query("n05_doi_key", f"WITH {DOIS} SELECT id, CASE o_orderstatus WHEN 'F' THEN '10.1016/x' WHEN 'O' THEN '10.1038/y' ELSE '10.9999/z' END || o_custkey AS k FROM v")
def _(t):
    return dois(t).select("id", fx.doi_key("doi").alias("k"))


@query("n06_publisher", f"WITH {DOIS} SELECT coalesce(CASE o_orderstatus WHEN 'F' THEN 'Elsevier' WHEN 'O' THEN 'Nature' END, '-') AS publisher, count(*) AS papers FROM v GROUP BY 1")
def _(t):
    return dois(t).groupBy(F.coalesce(fx.publisher(fx.doi_key("doi")), F.lit("-")).alias("publisher")).agg(F.count("*").alias("papers"))


@query("n07_surname", "SELECT c_custkey AS id, lower(c_mktsegment) AS s1, lower(c_mktsegment) AS s2, 'customer' AS s3 FROM customer")
def _(t):
    m, n = F.col("c_mktsegment"), F.col("c_name")
    return t.customer.select(F.col("c_custkey").alias("id"), fx.surname(F.concat(m, F.lit(", John"))).alias("s1"),
                             fx.surname(F.concat(F.lit("J. "), m, F.lit(" and Doe, A."))).alias("s2"), fx.surname(n).alias("s3"))


@query("n10_levenshtein", "SELECT a.s_suppkey AS id, levenshtein(a.s_name, c.c_name) AS d FROM supplier a JOIN customer c ON c.c_custkey = a.s_suppkey")
def _(t):
    return t.supplier.join(t.customer, F.col("c_custkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("id"), F.levenshtein("s_name", "c_name").alias("d"))


# pairs of consecutive parts: word sets of name and type
PAIR = """w AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS a FROM part),
  pr AS (SELECT x.id, x.a, y.a AS b FROM w x JOIN w y ON y.id = x.id + 1)"""


def word_pairs(t):
    w = t.part.select(F.col("p_partkey").alias("id"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("a"))
    return w.join(w.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")


@query("n11_fuzzy_jaccard", f"""WITH {PAIR}, m AS (SELECT id, len(list_intersect(a, b)) AS same, len(list_distinct(list_concat(a, b))) AS total,
      len(list_filter(a, lambda x: NOT list_contains(b, x) AND len(list_filter(b, lambda y: NOT list_contains(a, y) AND length(x) >= 5 AND length(y) >= 5 AND levenshtein(x, y) <= 2)) > 0)) AS near FROM pr)
    SELECT id, round((same + near) / total, 6) AS score FROM m""")
def _(t):
    return word_pairs(t).select("id", F.round(sim.fuzzy_jaccard(F.col("a"), F.col("b")), 6).alias("score"))


@query("n12_lcs_dice")
def _(t):
    return word_pairs(t).select("id", sim.lcs_dice(F.array_join("a", " "), F.array_join("b", " ")).alias("score"))


@query("n13_title_similarity")
def _(t):
    p = t.part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("x"))
    return p.join(p.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id").select("id", F.round(sim.title_similarity("x", "y"), 6).alias("score"))


@query("n14_block_ratio")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("x"))
    return c.join(c.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id").select("id", sim.block_ratio("x", "y").alias("score"))


@query("n15_author_score", """SELECT c_custkey AS id, CASE WHEN n_name = 'NATION_4' THEN 0.5 WHEN contains('ales ' || lower(r_name), lower(substring(c_mktsegment, 1, 3))) OR contains(lower(r_name), 'america') THEN 1.0 ELSE 0.0 END::DOUBLE AS score
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def _(t):
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    who = F.when(F.col("n_name") != "NATION_4", F.concat(F.lit("Al. America "), F.substring("c_mktsegment", 1, 3)))
    return rows.select(F.col("c_custkey").alias("id"), sim.author_score(who, F.array(F.lit("Ales"), F.col("r_name"))).alias("score"))


@query("n16_match_confidence", """SELECT o_orderkey AS id, round(0.5 * 0.8 + 0.3 * 0.5 + 0.2 * CASE abs(extract(year FROM o_orderdate) - 1998) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.0 END, 3)::DOUBLE AS score FROM orders""")
def _(t):
    y = sim.year_score(F.year("o_orderdate"), F.lit(1998))
    return t.orders.select(F.col("o_orderkey").alias("id"), sim.match_confidence(F.lit(0.8), F.lit(0.5), y).alias("score"))


@query("n18_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", fx.content_hash("text").alias("hash"))


@query("n19_numbers", r"""
    WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?')) AS s FROM documents), y AS (SELECT doc_id, TRY_CAST(replace(s, ',', '') AS DOUBLE) AS v FROM x)
    SELECT doc_id, count(*) AS n, round(max(v), 6) AS largest FROM y WHERE v IS NOT NULL GROUP BY 1""")
def _(t):
    rows = t.documents.select("doc_id", fx.numbers("text").alias("v")).filter(F.size("v") > 0)
    return rows.select("doc_id", F.size("v").cast("long").alias("n"), F.round(F.array_max("v"), 6).alias("largest"))


QUOTE_FORM = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace({c}, '["''‘’“”«»]', '', 'g'), '[-‐-―]', '', 'g')), '\s+', ' ', 'g'))"""


@query("n20_quote_form", f"SELECT doc_id, {QUOTE_FORM.format(c='text')} AS q FROM documents")
def _(t):
    return t.documents.select("doc_id", F.trim(fx.quote_form("text")).alias("q"))


RESPONSES = """r AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 'click' THEN 'Here: ' || replace(props, '}', ', }') || ' done'
      WHEN 'signup' THEN replace(props, '"k"', '"paper_type"') WHEN 'error' THEN 'no object' ELSE props END AS response, event_type, props FROM events)"""


def responses(t):
    p = F.col("props")
    text = (F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), p, F.lit("\n```")))
            .when(F.col("event_type") == "click", F.concat(F.lit("Here: "), F.replace(p, F.lit("}"), F.lit(", }")), F.lit(" done")))
            .when(F.col("event_type") == "signup", F.replace(p, F.lit('"k"'), F.lit('"paper_type"')))
            .when(F.col("event_type") == "error", F.lit("no object")).otherwise(p))
    return t.events.select(F.col("event_id").alias("id"), text.alias("response"))


@query("n21_response_object", f"""WITH {RESPONSES} SELECT id, event_type <> 'error' AS parsed, coalesce(CASE WHEN event_type NOT IN ('error', 'signup') THEN json_extract_string(props, '$.k') END, '-') AS k FROM r""")
def _(t):
    o = responses(t).withColumn("o", fx.response_object("response"))
    return o.select("id", F.col("o").isNotNull().alias("parsed"), F.coalesce(F.try_variant_get("o", "$.k", "string"), F.lit("-")).alias("k"))


@query("n22_missing_fields", f"""WITH {RESPONSES} SELECT id, CASE WHEN event_type = 'signup' THEN 'topics,one_sentence_summary' ELSE 'paper_type,topics,one_sentence_summary' END AS missing FROM r WHERE event_type <> 'error'""")
def _(t):
    o = responses(t).withColumn("o", fx.response_object("response")).filter("o IS NOT NULL")
    return o.select("id", F.array_join(fx.missing_fields("o", "quick"), ",").alias("missing"))


@query("n23_overlap_share", r"""
    WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS a FROM benchmark), n AS (SELECT x.item_id, x.a, y.a AS b FROM w x JOIN w y ON y.item_id = x.item_id + 1)
    SELECT item_id, round(len(list_intersect(a, b)) / len(a), 6) AS share FROM n""")
def _(t):
    w = t.benchmark.select("item_id", fx.content_words("text").alias("a"))
    p = w.join(w.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    return p.select("item_id", F.round(fx.overlap_share(F.col("a"), F.col("b")), 6).alias("share"))


@query("n24_topic_jaccard", f"WITH {PAIR} SELECT id, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 2) AS overlap FROM pr")
def _(t):
    return word_pairs(t).select("id", fx.jaccard(F.col("a"), F.col("b")).alias("overlap"))


@query("n25_current_status", "SELECT CASE event_type WHEN 'view' THEN 'needs_extraction' WHEN 'click' THEN 'needs_chunking' ELSE event_type END AS status, count(*) AS n FROM events GROUP BY 1")
def _(t):
    legacy = F.when(F.col("event_type") == "view", "needs_abstract").when(F.col("event_type") == "click", "needs_chunks").otherwise(F.col("event_type"))
    return t.events.groupBy(fx.current_status(legacy).alias("status")).agg(F.count("*").alias("n"))


# --- chunks --------------------------------------------------------------------------
@query("c01_chunk_stride", """
    SELECT doc_id, i AS chunk_index, substring(text, (i * 450 + 1)::INT, 500) AS text, i * 450 AS start_char
    FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1))) AS i FROM documents WHERE length(text) > 0)""")
def _(t):
    return chunking.chunk_stride(t.documents).withColumn("chunk_index", F.col("chunk_index").cast("long")).withColumn("start_char", F.col("start_char").cast("long"))


@query("c01_chunk_chars")
def _(t):
    return chunking.chunk_chars(t.documents)


# boundaries one after the other: the last sentence end in the window's final fifth, else the window's end
@query("c01_chunk_chars_places", r"""
    WITH RECURSIVE d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    cut(doc_id, t, s, e) AS (SELECT doc_id, t, -1, 0 FROM d WHERE t <> ''
      UNION ALL SELECT doc_id, t, s, CASE WHEN s + 500 >= length(t) THEN length(t) WHEN k IS NOT NULL AND k < 99 AND NOT closed THEN s + 500 - k - 1 ELSE s + 500 END
      FROM (SELECT *, CASE WHEN regexp_matches(r, ' [.!?]') THEN length(regexp_extract(r, '^(.*?) [.!?]', 1)) END AS k, regexp_matches(r, '^[.!?]') AS closed
        FROM (SELECT *, reverse(substring(t, s + 1, 500)) AS r FROM (SELECT doc_id, t, CASE WHEN s < 0 THEN 0 WHEN e - 50 > s THEN e - 50 ELSE e END AS s FROM cut WHERE e < length(t)))))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s)::INT - 1 AS chunk_index, trim(substring(t, s + 1, e - s)) AS text, s AS start_char, e AS end_char FROM cut WHERE s >= 0""")
def _(t):
    return chunking.chunk_chars(t.documents).drop("section")


@query("c01_chunk_breaks", r"""
    WITH RECURSIVE cut(doc_id, t, s, e) AS (SELECT doc_id, text, -1, 0 FROM documents WHERE trim(text) <> ''
      UNION ALL SELECT doc_id, t, s, CASE WHEN s + 400 >= length(t) THEN length(t) WHEN gap > 0 AND gap < 199 THEN s + 401 - gap WHEN dot > 0 AND dot < 200 THEN s + 401 - dot ELSE s + 400 END
      FROM (SELECT *, instr(r, chr(10) || chr(10)) AS gap, instr(r, '.') AS dot
        FROM (SELECT *, reverse(substring(t, s + 1, 400)) AS r FROM (SELECT doc_id, t, CASE WHEN s < 0 THEN 0 ELSE greatest(e - 40, s + 1) END AS s FROM cut WHERE e < length(t)))))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s)::INT - 1 AS chunk_index, substring(t, s + 1, e - s) AS text, s AS start_char, e AS end_char, NULL::VARCHAR AS section FROM cut WHERE s >= 0""")
def _(t):
    return chunking.chunk_breaks(t.documents, tokens=100, overlap=10)


# conversations as papers: a turn is a section, its role names the header
PAPER_TEXT = """pt AS (SELECT conv_id AS doc_id, string_agg(CASE role WHEN 'system' THEN 'Abstract' WHEN 'user' THEN '1. Introduction' ELSE 'Results' END || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text
    FROM conversations GROUP BY 1)"""


def paper_text(t):
    head = F.when(F.col("role") == "system", "Abstract").when(F.col("role") == "user", "1. Introduction").otherwise("Results")
    item = F.struct("turn", F.concat(head, F.lit("\n\n"), "text").alias("s"))
    return t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(item)), lambda x: x["s"]), "\n\n").alias("text"))


@query("c02_chunk_paragraphs", f"""WITH RECURSIVE {PAPER_TEXT},
    ps AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS l FROM pt),
    p AS (SELECT doc_id, i, l[i] AS s, len(list_filter(regexp_split_to_array(l[i], '\\s+'), lambda x: x <> '')) AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM ps)),
    run(doc_id, i, chunk, n) AS (SELECT doc_id, 1::BIGINT, 0::BIGINT, w FROM p WHERE i = 1
      UNION ALL SELECT p.doc_id, p.i, CASE WHEN r.n + p.w > 80 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.n + p.w > 80 THEN p.w ELSE r.n + p.w END FROM run r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
    SELECT doc_id, chunk AS chunk_index, string_agg(p.s, chr(10) || chr(10) ORDER BY i) AS text FROM run JOIN p USING (doc_id, i) GROUP BY 1, 2""")
def _(t):
    return chunking.chunk_paragraphs(paper_text(t), 80).withColumn("chunk_index", F.col("chunk_index").cast("long"))


HINTS = f"""{PAPER_TEXT}, ln AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM pt),
  lx AS (SELECT doc_id, i, l[i] AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM ln)),
  lo AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char FROM lx),
  hints AS (SELECT doc_id, i AS line, start_char, CASE s WHEN 'Abstract' THEN 'Abstract' WHEN '1. Introduction' THEN 'Introduction' ELSE 'Results' END AS section FROM lo WHERE s IN ('Abstract', '1. Introduction', 'Results'))"""


@query("c04_section_hints", f"WITH {HINTS} SELECT doc_id, line, start_char, section, 0.9::DOUBLE AS confidence FROM hints")
def _(t):
    return chunking.section_hints(paper_text(t))


@query("c04_section_hints_documents")
def _(t):
    return chunking.section_hints(t.documents)


@query("c05_document_type", f"""WITH {HINTS}, g AS (SELECT doc_id, count(*) AS n FROM hints GROUP BY 1)
    SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words, regexp_matches(substring(text, 1, 5000), '(?i)\\babstract\\b') AS has_abstract,
      regexp_matches(right(text, 10000), '(?i)\\breferences?\\b|\\bbibliography\\b') AS has_references,
      CASE WHEN n > 10 THEN 'review' WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) < 4000 THEN 'short_communication' END AS document_type,
      CASE WHEN n > 10 THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence FROM pt LEFT JOIN g USING (doc_id)""")
def _(t):
    d = paper_text(t)
    return chunking.document_type(d, chunking.section_hints(d))


@query("c03_chunk_sections", f"""WITH {HINTS}, nx AS (SELECT *, lead(start_char) OVER (PARTITION BY doc_id ORDER BY start_char) AS e, count(*) OVER (PARTITION BY doc_id) AS k FROM hints),
    b AS (SELECT doc_id, start_char, section, regexp_replace(substring(text, (start_char + 1)::INT, (coalesce(e, length(text)) - start_char)::INT), '^\\s+|\\s+$', '', 'g') AS body FROM nx JOIN pt USING (doc_id) WHERE k >= 2)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1 AS chunk_index, '[Section: ' || section || ']' || chr(10) || chr(10) || body AS text FROM b WHERE body <> ''""")
def _(t):
    d = paper_text(t)
    return chunking.chunk_sections(d, chunking.section_hints(d), 100000).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("c03_chunk_sections_parts")
def _(t):
    d = paper_text(t)
    return chunking.chunk_sections(d, chunking.section_hints(d), 40)


# orders as papers with a reference section and figure captions
BIB_TEXT = """bt AS (SELECT l_orderkey AS doc_id, 'Body text' || chr(10) || string_agg('Fig. ' || n || '. Overview of ' || p_name, chr(10) ORDER BY n) || chr(10) || 'References' || chr(10)
      || string_agg('[' || n || '] Lee J. (' || y || ') Study of ' || p_name || '. Journal of Parts, doi:10.1000/P' || l_partkey, chr(10) ORDER BY n) || chr(10) || 'Appendix' || chr(10) || '[99] not a reference of this list' AS text
    FROM nl GROUP BY 1)"""
NUMBERED = """nl AS (SELECT l_orderkey, l_partkey, p_name, CAST(extract(year FROM l_shipdate) AS INT) AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def numbered(t):
    from pyspark.sql import Window
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        "l_orderkey", "l_partkey", "p_name", F.year("l_shipdate").alias("y"), F.row_number().over(w).alias("n"))


def bib_text(t):
    n, s = F.col("n").cast("string"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    rows = numbered(t).select(F.col("l_orderkey").alias("doc_id"), F.struct("n", s("Fig. ", n, ". Overview of ", F.col("p_name")).alias("f"),
        s("[", n, "] Lee J. (", F.col("y").cast("string"), ") Study of ", F.col("p_name"), ". Journal of Parts, doi:10.1000/P", F.col("l_partkey").cast("string")).alias("r")).alias("x"))
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    part = lambda f: F.array_join(F.transform("x", lambda v: v[f]), "\n")
    return g.select("doc_id", s("Body text\n", part("f"), "\nReferences\n", part("r"), "\nAppendix\n[99] not a reference of this list").alias("text"))


@query("c06_extract_references", f"""WITH {NUMBERED} SELECT l_orderkey AS doc_id, n - 1 AS reference_order, n AS number,
    'Lee J. (' || y || ') Study of ' || p_name || '. Journal of Parts, doi:10.1000/P' || l_partkey AS raw_text FROM nl""")
def _(t):
    return structure.extract_references(bib_text(t))


@query("c07_parse_references", f"""WITH {NUMBERED} SELECT l_orderkey AS doc_id, n AS number, '10.1000/P' || l_partkey AS parsed_doi, y AS parsed_year, 'Lee J. (' AS parsed_authors,
    ') Study of ' || p_name AS parsed_title, 0.9::DOUBLE AS parse_confidence FROM nl""")
def _(t):
    out = structure.parse_references(structure.extract_references(bib_text(t)))
    return out.select("doc_id", "number", "parsed_doi", "parsed_year", "parsed_authors", "parsed_title", "parse_confidence")


@query("c08_captions", f"""WITH {NUMBERED} SELECT l_orderkey AS doc_id, 'figure' AS figure_type, CAST(n AS VARCHAR) AS figure_number,
    'Overview of ' || p_name || CASE WHEN n = max(n) OVER (PARTITION BY l_orderkey) THEN '' ELSE '' END AS caption FROM nl""")
def _(t):
    return structure.captions(bib_text(t)).drop("caption_order")


@query("c10_condense")
def _(t):
    return structure.condense(t.documents, 5000)


@query("c10_condense_lengths", "SELECT doc_id, length(text) AS chars, length(text) <= 5000 AS whole FROM documents")
def _(t):
    out = structure.condense(t.documents.withColumn("raw", F.col("text")), 5000).join(t.documents.select("doc_id", "text"), "doc_id")
    return out.select("doc_id", F.col("chars").cast("long").alias("chars"), (F.col("condensed") == F.col("text")).alias("whole"))


# conversations as manuscripts: a turn is a section citing its role and its number
def tex_files(t):
    s = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    body = F.regexp_replace("text", r"[\\{}#\[\]]", " ")
    part = s("\\section{", F.col("role"), " ", F.col("turn").cast("string"), "}\n", body, "\nsee \\citep{", F.col("role"), ", t", F.col("turn").cast("string"), "} and \\cite{all}")
    return t.conversations.groupBy(F.col("conv_id").cast("string").alias("file")).agg(F.concat(
        F.lit("\\title{A talk}\n\\begin{abstract}short\\end{abstract}\n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n")).alias("value"))


WORDS = r"len(list_filter(regexp_split_to_array(regexp_replace(text, '[\\{}#\[\]]', ' ', 'g'), '\s+'), lambda x: x <> ''))"


@query("c11_latex_sections", f"""SELECT CAST(conv_id AS VARCHAR) AS file, turn + 1 AS section_no, role || ' ' || turn AS title, 1 AS level, {WORDS} + 5 AS words,
    array_to_string(list_sort(['all', role, 't' || turn]), ',') AS citations FROM conversations""")
def _(t):
    out = structure.latex_sections(tex.text_lines(tex_files(t)))
    return out.select("file", "section_no", "title", "level", "words", JOIN("citations"))


@query("c11_manuscripts", """SELECT CAST(conv_id AS VARCHAR) AS file, 'A talk' AS title, 'short' AS abstract, (SELECT string_agg(c, ',' ORDER BY c) FROM (
      SELECT DISTINCT role AS c FROM conversations y WHERE y.conv_id = x.conv_id UNION SELECT 't' || turn FROM conversations y WHERE y.conv_id = x.conv_id UNION SELECT 'all')) AS citations
    FROM (SELECT DISTINCT conv_id FROM conversations) x""")
def _(t):
    return structure.manuscripts(tex_files(t)).select("file", "title", "abstract", JOIN("citations"))


@query("c11_markdown_sections", f"""SELECT CAST(conv_id AS VARCHAR) AS file, turn + 1 AS section_no, role || ' ' || turn AS title, 2 AS level, {WORDS} + 2 AS words, role || ',' || 'Lee2020' AS citations
    FROM conversations""")
def _(t):
    s = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    part = s("## ", F.col("role"), " ", F.col("turn").cast("string"), "\n", F.regexp_replace("text", r"[\\{}#\[\]]", " "), "\n[Lee2020] [@", F.col("role"), "]")
    files = t.conversations.groupBy(F.col("conv_id").cast("string").alias("file")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("value"))
    out = structure.markdown_sections(tex.text_lines(files))
    return out.select("file", "section_no", "title", "level", "words", F.array_join(F.reverse(F.array_sort("citations")), ",").alias("citations"))


@query("c12_tex_citations", """SELECT key, count(*) AS occurrences, count(DISTINCT conv_id) AS files FROM (SELECT conv_id, unnest([role, 't' || turn, 'all']) AS key FROM conversations) GROUP BY 1""")
def _(t):
    return tex.citation_counts(tex.tex_citations(tex.text_lines(tex_files(t))))


@query("c12_page_links", """SELECT k AS key, count(*) AS occurrences, count(DISTINCT page_id) AS files FROM (
      SELECT page_id, trim(unnest(flatten(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda g: string_split(g, ','))))) AS k FROM pages) GROUP BY 1""")
def _(t):
    lines = tex.text_lines(t.pages.select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("value")))
    return tex.citation_counts(tex.tex_citations(lines, r'href="([^"]*)"'))


@query("c13_document_view", """
    SELECT conv_id AS paper_id, count(*) AS n_chunks, '# Talk ' || conv_id || chr(10) || chr(10) || 'Year: 2020' || chr(10) || chr(10) || '[' || sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) || ' words | ' || count(*) || ' chunks]'
      || chr(10) || chr(10) || '## Full Text' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || '---' || chr(10) || '## Figure/Table Captions (' || count(*) || ')' || chr(10) || chr(10)
      || string_agg('**Figure ' || turn || ':** ' || role, chr(10) ORDER BY turn) AS view FROM conversations GROUP BY 1""")
def _(t):
    papers = t.conversations.select(F.col("conv_id").alias("id")).distinct().select(
        "id", F.concat(F.lit("Talk "), F.col("id").cast("string")).alias("title"), F.array().cast("array<string>").alias("authors"), F.lit(2020).alias("year"))
    figs = t.conversations.select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("figure_order"), F.lit("figure").alias("figure_type"),
                                  F.col("turn").cast("string").alias("figure_number"), F.col("role").alias("caption"))
    tabs = figs.filter("figure_type = 'table'").select("paper_id", F.col("figure_order").alias("table_order"), "caption", F.col("caption").alias("markdown"))
    return structure.document_view(papers, t.chunks, tabs, figs).select("paper_id", "n_chunks", "view")


@query("c14_work_packets", """
    WITH p AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w, length(text) AS n FROM documents),
    c AS (SELECT DISTINCT a.id, b.source AS project FROM docs a JOIN docs b ON lower(trim(regexp_replace(regexp_replace(lower(a.title), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))) = trim(regexp_replace(regexp_replace(lower(b.title), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))
      JOIN labels l ON l.doc_id = b.id WHERE trim(regexp_replace(regexp_replace(lower(b.title), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) <> '')
    SELECT p.doc_id AS id, n > 3000 AS truncated, w AS word_count, w > 15000 AS likely_review, coalesce((SELECT string_agg(project, ',' ORDER BY project) FROM c WHERE c.id = p.doc_id), '') AS cited FROM p""", "docs")
def _(t):
    none = F.lit(None).cast("string")
    lib = t.docs.join(t.labels, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("source").alias("project"), none.alias("doi"), "title")
    cited = linkage.cited_in_projects(t.docs.withColumn("doi", none), lib)
    out = structure.work_packets(t.docs.withColumn("abstract", F.lit("")), t.documents.select(F.col("doc_id").alias("paper_id"), "text"),
                                 lib.select("project").distinct(), cited, max_chars=3000)
    names = F.transform(F.filter("projects", lambda p: p["already_cited"]), lambda p: p["project"])
    return out.select("id", "truncated", F.col("word_count").cast("long").alias("word_count"), "likely_review", F.array_join(names, ",").alias("cited"))


# --- sources and exports -------------------------------------------------------------
def bib_files(t):
    """Bibliography files, one per customer: each order is an entry in BibTeX text."""
    s = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    entry = s("@Article{order", F.col("id").cast("string"), ",\n  Title = {Report {on} ", F.col("id").cast("string"), "},\n  year = ", F.col("year").cast("string"),
              ",\n  note = \"", F.col("read_status"), "\"\n}")
    return t.papers.groupBy(F.col("owner_id").cast("string").alias("file")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))), lambda x: x["e"]), "\n\n").alias("value"))


@query("s02_bib_entries", """SELECT CAST(owner_id AS VARCHAR) AS file, 'order' || id AS key, 'article' AS type, 'Report on ' || id AS title, CAST(year AS VARCHAR) AS year, read_status AS note FROM papers""", "papers")
def _(t):
    f = lambda k: F.col("fields")[k].alias(k)
    return bibtex.bib_entries(bib_files(t)).select("file", "key", "type", f("title"), f("year"), f("note"))


@query("s02_bib_values", """SELECT CAST(owner_id AS VARCHAR) AS file, 'order' || id AS key, 'mail me@x.org, now' AS note, 'House of ' || owner_id || ' & Co' AS publisher, 'a deep one ' || id AS title, CAST(owner_id AS VARCHAR) AS series FROM papers""", "papers")
def _(t):
    # values with addresses and deep braces, a name per file, and a series that comes from a parent entry
    s = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    head = s("@string{house = {House of ", F.col("owner_id").cast("string"), "}}\n@book{Parent, series = ", F.col("owner_id").cast("string"), "}\n")
    entry = s("@incollection{order", F.col("id").cast("string"), ",\n  title = {a {deep {{one}}} ", F.col("id").cast("string"), "}, note = \"mail me@x.org, now\",\n  crossref = {parent}, publisher = house # { \\& Co},\n}")
    files = t.papers.groupBy("owner_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))), lambda x: x["e"]), "\n").alias("body"))
    files = files.select(F.col("owner_id").cast("string").alias("file"), F.concat(head, "body").alias("value"))
    f = lambda k: F.col("fields")[k].alias(k)
    return bibtex.bib_entries(files).filter("key <> 'Parent'").select("file", "key", f("note"), f("publisher"), f("title"), f("series"))


@query("s03_text_lines", """SELECT file, count(*) AS lines, max(n) AS last FROM (SELECT CAST(page_id AS VARCHAR) AS file, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS n FROM pages) GROUP BY 1""")
def _(t):
    lines = tex.text_lines(t.pages.select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("value")))
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.max(F.col("line").cast("long")).alias("last"))


@query("s04_attachments", """
    SELECT l.l_orderkey * 100 + 0 AS parent, l.l_partkey || '.pdf' AS file_name, o.o_orderpriority AS type_name FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
    WHERE l.l_returnflag = 'A' AND l.l_linestatus = 'F' AND o.o_orderstatus <> 'P'""")
def _(t):
    items = t.orders.select(F.col("o_orderkey").alias("itemID"), F.col("o_orderpriority").alias("itemTypeID"), F.col("o_orderkey").cast("string").alias("key"))
    child = t.lineitem.select(F.xxhash64(*t.lineitem.columns).alias("itemID"), F.col("l_orderkey").alias("parentItemID"),
                              F.when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("linkMode"),
                              F.when(F.col("l_linestatus") == "F", "application/pdf").otherwise("text/html").alias("contentType"),
                              F.concat(F.lit("storage:"), F.col("l_partkey").cast("string"), F.lit(".pdf")).alias("path"))
    every = items.unionByName(child.select("itemID", F.lit("x").alias("itemTypeID"), F.col("itemID").cast("string").alias("key")))
    kinds = t.orders.select(F.col("o_orderpriority").alias("itemTypeID")).distinct().withColumn("typeName", F.col("itemTypeID"))
    gone = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("itemID"))
    out = refmanager.attachments(every, kinds, child, gone)
    return out.select((F.col("parentItemID") * 100).alias("parent"), "file_name", F.col("typeName").alias("type_name"))


@query("s05_item_metadata", """
    SELECT o.o_orderkey AS id, o.o_orderstatus AS title, CAST(extract(year FROM o.o_orderdate) AS INT) AS year, coalesce((SELECT string_agg(s.s_name, ';' ORDER BY x.position, s.s_name) FROM paper_authors x JOIN supplier s ON s.s_suppkey = x.author_id WHERE x.paper_id = o.o_orderkey), '') AS authors
    FROM orders o""", "paper_authors")
def _(t):
    items = t.orders.select(F.col("o_orderkey").alias("itemID"), F.col("o_orderkey").cast("string").alias("key"))
    data = t.orders.select(F.col("o_orderkey").alias("itemID"), F.explode(F.array(
        F.struct(F.lit(1).alias("fieldID"), F.col("o_orderstatus").alias("value")), F.struct(F.lit(2).alias("fieldID"), F.date_format("o_orderdate", "MMMM d yyyy").alias("value")))).alias("v"))
    data = data.select("itemID", "v.fieldID", F.concat_ws("|", F.col("v.fieldID").cast("string"), "v.value").alias("valueID"), "v.value")
    fields = t.spark.createDataFrame([(1, "title"), (2, "date")], "fieldID int, fieldName string")
    people = t.supplier.select(F.col("s_suppkey").alias("creatorID"), F.lit(None).cast("string").alias("firstName"), F.col("s_name").alias("lastName"))
    ic = t.paper_authors.select(F.col("paper_id").alias("itemID"), F.col("author_id").alias("creatorID"), F.col("position").alias("orderIndex"))
    out = refmanager.item_metadata(items, data.select("itemID", "fieldID", "valueID"), fields, data.select("valueID", "value").distinct(), people, ic)
    return out.select(F.col("itemID").alias("id"), "title", "year", F.array_join("authors", ";").alias("authors"))


@query("s06_json_rows", """
    SELECT p.id, coalesce(a.n, 0) AS authors, coalesce(g.n, 0) AS tags, coalesce(e.n, 0) AS notes FROM papers p
    LEFT JOIN (SELECT paper_id, count(*) AS n FROM paper_authors GROUP BY 1) a ON a.paper_id = p.id LEFT JOIN (SELECT paper_id, count(*) AS n FROM paper_tags GROUP BY 1) g ON g.paper_id = p.id
    LEFT JOIN (SELECT paper_id, count(*) AS n FROM notes GROUP BY 1) e ON e.paper_id = p.id""", "papers paper_authors paper_tags notes")
def _(t):
    rows = exports.json_rows(t.papers, t.paper_authors, t.authors, t.paper_tags, t.notes)
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long").alias(c)
    return rows.select("id", size("authors"), size("tags"), size("notes"))


def with_people(t):
    out = enrich.with_authors_tags(t.papers, t.paper_authors, t.authors, t.paper_tags)
    return out.withColumn("journal", F.when(F.col("rating") > 2, F.col("read_status")))


PEOPLE = "ap AS (SELECT paper_id, list(name ORDER BY position, name) AS n FROM paper_authors x JOIN authors a ON a.id = x.author_id GROUP BY 1)"


@query("s07_csv_rows", f"""WITH {PEOPLE} SELECT p.id, p.title, coalesce(array_to_string(n, '; '), '') AS authors, p.year, CASE WHEN rating > 2 THEN read_status END AS journal, p.doi
    FROM papers p LEFT JOIN ap ON ap.paper_id = p.id""", "papers authors paper_authors")
def _(t):
    return exports.csv_rows(with_people(t))


STYLE = f"""WITH {PEOPLE}, x AS (SELECT p.id, coalesce(array_to_string(n, ', '), 'Unknown') AS who, p.title, p.year, CASE WHEN rating > 2 THEN read_status END AS j, p.doi FROM papers p LEFT JOIN ap ON ap.paper_id = p.id)
    SELECT id, """


@query("s08_apa", STYLE + "concat_ws(' ', who || ' (' || year || '). ' || title || '.', j || '.', 'https://doi.org/' || doi) AS reference FROM x", "papers authors paper_authors")
def _(t):
    return exports.reference_text(with_people(t), "apa").select("id", "reference")


@query("s08_mla", STYLE + """concat_ws(' ', who || '. "' || title || '."', j || ',', year || '.') AS reference FROM x""", "papers authors paper_authors")
def _(t):
    return exports.reference_text(with_people(t), "mla").select("id", "reference")


@query("s08_chicago", STYLE + """concat_ws(' ', who || '. "' || title || '."', j, '(' || year || ').') AS reference FROM x""", "papers authors paper_authors")
def _(t):
    return exports.reference_text(with_people(t), "chicago").select("id", "reference")


@query("s08_bibtex", f"""WITH {PEOPLE} SELECT p.id, CASE WHEN n IS NULL THEN 'unknown' ELSE 'supplier' END || year || 'report' AS key,
      '@article{{' || CASE WHEN n IS NULL THEN 'unknown' ELSE 'supplier' END || year || 'report,' || chr(10) || array_to_string(list_filter(['  title = {{' || title || '}}', '  author = {{' || array_to_string(n, ' and ') || '}}', '  year = {{' || year || '}}',
        '  journal = {{' || CASE WHEN rating > 2 THEN read_status END || '}}', '  doi = {{' || doi || '}}'], lambda v: v IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS bibtex
    FROM papers p LEFT JOIN ap ON ap.paper_id = p.id""", "papers authors paper_authors")
def _(t):
    return bibtex.bibtex_text(with_people(t))


@query("s09_vector_replace", "SELECT vec_id AS id, label AS paper_id, CASE WHEN label IN (SELECT r_regionkey FROM region) THEN 'new' ELSE 'old' END AS version FROM embeddings")
def _(t):
    import uuid
    from quire.session import shared_folder
    path = f"{shared_folder(t.spark)}/vectors-{uuid.uuid4().hex}"
    rows = t.vectors.select("id", F.col("label").alias("paper_id"), "embedding")
    vectorstore.write_vectors(rows.withColumn("version", F.lit("old")), path)
    again = rows.join(t.region, F.col("paper_id") == F.col("r_regionkey"), "left_semi")
    vectorstore.write_vectors(again.withColumn("version", F.lit("new")), path)
    return vectorstore.read_vectors(t.spark, path).select("id", "paper_id", "version")


@query("s01_library_tables", """
    SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS orcid, CAST(count(o_orderkey) AS BIGINT) AS papers FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def _(t):
    # customers written as authors, their orders as their papers; columns the files lack read as null
    from quire.session import shared_folder
    path = f"{shared_folder(t.spark)}/library-{uuid.uuid4().hex}"
    t.customer.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name")).write.parquet(f"{path}/authors.parquet")
    t.orders.select(F.col("o_orderkey").cast("long").alias("paper_id"), F.col("o_custkey").cast("long").alias("author_id"), F.lit(0).alias("position")).write.parquet(f"{path}/paper_authors.parquet")
    lib = library.read_library(t.spark, path, ["authors", "paper_authors"])
    n = lib["paper_authors"].groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("papers"))
    return lib["authors"].join(n, "id", "left").select("id", "name", "orcid", F.coalesce("papers", F.lit(0)).cast("long").alias("papers"))


@query("s10_projects", "SELECT s_name AS name, 'nation ' || s_nationkey AS focus, 1 AS topics FROM supplier WHERE s_suppkey % 3 <> 0")
def _(t):
    # one registry file per nation
    from quire.session import shared_folder
    path = f"{shared_folder(t.spark)}/projects-{uuid.uuid4().hex}"
    one = F.struct(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, False).alias("active"), F.array(F.col("s_name")).alias("topics"),
                   F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("focus"))
    t.supplier.groupBy("s_nationkey").agg(F.collect_list(one).alias("projects")).write.partitionBy("s_nationkey").json(path)
    return projects.read_projects(t.spark, path).select("name", "focus", F.size("topics").alias("topics"))
