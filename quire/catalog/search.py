"""Text search (R01-R06, R13-R18) and windows on ranked lists (W)."""

from pyspark.sql import functions as F

from quire.catalog.registry import query
from quire.operators import bounded, ranking, retrieval, rewrite, search, textindex

ABSTRACT = {"abstract": 5.0}

# tokens of two weighted fields, term statistics and BM25 of every (query, document)
TOK = r"""ft AS (SELECT id AS doc_id, 'title' AS field, 10.0 AS w, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') AS toks FROM docs
          UNION ALL SELECT id, 'abstract', 5.0, regexp_extract_all(lower(abstract), '[\p{L}\p{N}]+') FROM docs),
  dl AS (SELECT doc_id, sum(len(toks)) AS dl FROM ft GROUP BY 1),
  tok AS (SELECT doc_id, field, w, unnest(toks) AS term FROM ft),
  post AS (SELECT term, doc_id, sum(w) AS f, count(*) AS tf FROM tok GROUP BY 1, 2),
  dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
  corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"""


def bm25_sql(q, name="scored"):
    return rf"""qt{name} AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+')) AS term FROM {q}),
  {name} AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6)::DOUBLE AS score
    FROM qt{name} JOIN post USING (term) JOIN dfs USING (term) JOIN dl USING (doc_id), corpus GROUP BY 1, 2)"""


def top(source, k, keys="score DESC, doc_id", by="query_id"):
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {keys}) AS rank FROM {source}) WHERE rank <= {k}"


def index(t, queries=None):
    """Index of the documents; postings are limited to the batch's terms when queries are known."""
    only = None if queries is None else textindex.query_terms(queries)
    return textindex.stored(textindex.build_index(t.docs, only=only))


@query("r01_index_terms", rf"WITH {TOK} SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences, sum(f)::DOUBLE AS weighted FROM post GROUP BY term", "docs")
def _(t):
    return textindex.build_index(t.docs).postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.sum("f").alias("weighted"))


@query("r01_document_lengths", rf"WITH {TOK} SELECT doc_id, dl::BIGINT AS dl FROM dl", "docs")
def _(t):
    return textindex.build_index(t.docs).docs


@query("r01_stemmed_terms")
def _(t):
    return textindex.build_index(t.docs, ABSTRACT, stemmed=True).terms


@query("r02_index_status", """
    SELECT count(*) FILTER (WHERE lang = 'en') AS indexed, count(*) AS total, count(*) FILTER (WHERE lang <> 'en') AS missing, 0 AS stale, TRUE AS needs_rebuild FROM docs""", "docs")
def _(t):
    done = textindex.tokenised(t.docs.filter("lang = 'en'"), ABSTRACT)
    return textindex.index_status(t.docs, done.select("doc_id"))


@query("r02_missing_docs", "SELECT id AS doc_id FROM docs WHERE lang <> 'en'", "docs")
def _(t):
    return textindex.missing_docs(t.docs, textindex.tokenised(t.docs.filter("lang = 'en'"), ABSTRACT).select("doc_id"))


@query("r03_bm25", f"WITH {TOK}, {bm25_sql('search_queries')} SELECT query_id, doc_id, score, rank FROM ({top('scored', 10)})", "docs search_queries")
def _(t):
    only = textindex.query_terms(t.search_queries)
    return retrieval.bm25(t.search_queries, textindex.build_index(t.docs, only=only), k=10)


@query("r03_bm25_years", f"""WITH {TOK}, {bm25_sql('search_queries')},
    kept AS (SELECT s.* FROM scored s JOIN docs d ON d.id = s.doc_id WHERE d.year BETWEEN 2000 AND 2010)
    SELECT query_id, doc_id, score, rank FROM ({top('kept', 20)})""", "docs search_queries")
def _(t):
    return retrieval.bm25(t.search_queries, index(t, t.search_queries), docs=t.docs, year_min=2000, year_max=2010, k=20)


def blocked(t):
    return bounded.stored_blocked(textindex.build_index(t.docs, only=textindex.query_terms(t.search_queries)))


@query("r03_bm25_bounded", f"WITH {TOK}, {bm25_sql('search_queries')} SELECT query_id, doc_id, score, rank FROM ({top('scored', 10)})", "docs search_queries")
def _(t):
    return bounded.bm25(t.search_queries, blocked(t), k=10)


@query("r03_bm25_bounded_years", f"""WITH {TOK}, {bm25_sql('search_queries')},
    kept AS (SELECT s.* FROM scored s JOIN docs d ON d.id = s.doc_id WHERE d.year BETWEEN 2000 AND 2010)
    SELECT query_id, doc_id, score, rank FROM ({top('kept', 20)})""", "docs search_queries")
def _(t):
    return bounded.bm25(t.search_queries, blocked(t), docs=t.docs, year_min=2000, year_max=2010, k=20)


@query("r03_postings_read")
def _(t):
    return bounded.postings_read(t.search_queries, blocked(t), k=10)


@query("r04_any_terms", f"""WITH {TOK}, q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM search_queries)
    SELECT query_id, doc_id, count(*) AS matched_terms FROM q JOIN post USING (term) GROUP BY 1, 2""", "docs search_queries")
def _(t):
    return retrieval.any_terms(t.search_queries, index(t, t.search_queries))


@query("r04_all_terms", f"""WITH {TOK}, q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM search_queries),
    n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1)
    SELECT query_id, doc_id, count(*) AS matched_terms FROM q JOIN post USING (term) JOIN n USING (query_id) GROUP BY 1, 2, n HAVING count(*) = n""", "docs search_queries")
def _(t):
    return retrieval.all_terms(t.search_queries, index(t, t.search_queries))


# three operator queries from every benchmark text: a AND b NOT c, plain words, a quoted phrase
BOOL = r"""w AS (SELECT item_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: upper(x) NOT IN ('AND', 'OR', 'NOT')) AS t FROM benchmark),
  bq AS (SELECT item_id * 3 AS query_id, t[1] || ' AND ' || t[2] || ' NOT ' || t[3] AS query, 'all' AS mode, [lower(t[1]), lower(t[2])] AS want, lower(t[3]) AS ban FROM w
         UNION ALL SELECT item_id * 3 + 1, t[4] || ' ' || t[5] || ' NOT ' || t[6], 'any', [lower(t[4]), lower(t[5])], lower(t[6]) FROM w
         UNION ALL SELECT item_id * 3 + 2, '"' || t[7] || ' ' || t[8] || '"', 'phrase', [lower(t[7]), lower(t[8])], NULL FROM w)"""


def operator_queries(t):
    w = t.benchmark.select("item_id", F.filter(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)),
                                               lambda x: ~F.upper(x).isin("AND", "OR", "NOT")).alias("t"))
    g = lambda i: F.col("t")[i - 1]
    make = lambda n, q: w.select((F.col("item_id") * 3 + n).alias("query_id"), q.alias("query"))
    return (make(0, F.concat(g(1), F.lit(" AND "), g(2), F.lit(" NOT "), g(3)))
            .unionByName(make(1, F.concat(g(4), F.lit(" "), g(5), F.lit(" NOT "), g(6))))
            .unionByName(make(2, F.concat(F.lit('"'), g(7), F.lit(" "), g(8), F.lit('"')))))


@query("r04_query_mode", f"WITH {BOOL} SELECT query_id, mode FROM bq")
def _(t):
    return operator_queries(t).select("query_id", retrieval.query_mode("query").alias("mode"))


@query("r04_boolean_match", f"""WITH {TOK}, {BOOL}, want AS (SELECT query_id, mode, len(list_distinct(want)) AS n, unnest(list_distinct(want)) AS term FROM bq WHERE mode <> 'phrase'),
    hit AS (SELECT query_id, doc_id, any_value(mode) AS mode, any_value(n) AS n, count(*) AS c FROM want JOIN post USING (term) GROUP BY 1, 2),
    texts AS (SELECT doc_id, ' ' || array_to_string(toks, ' ') || ' ' AS s FROM ft),
    ok AS (SELECT query_id, doc_id FROM hit WHERE mode = 'any' OR c = n
           UNION SELECT query_id, doc_id FROM (SELECT * FROM bq WHERE mode = 'phrase') p JOIN texts ON contains(s, ' ' || want[1] || ' ' || want[2] || ' ')),
    banned AS (SELECT query_id, doc_id FROM bq JOIN post ON term = ban)
    SELECT query_id, doc_id FROM ok ANTI JOIN banned USING (query_id, doc_id)""", "docs")
def _(t):
    q = operator_queries(t)
    return retrieval.boolean_match(q, index(t, q))


@query("r05_phrase", f"""WITH {TOK}, joined AS (SELECT doc_id, ' ' || array_to_string(toks, ' ') || ' ' AS s FROM ft)
    SELECT DISTINCT query_id, doc_id FROM search_queries q JOIN joined j ON contains(j.s, ' ' || array_to_string(regexp_extract_all(lower(q.query), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ')""",
       "docs search_queries")
def _(t):
    return retrieval.phrase_match(t.search_queries, index(t, t.search_queries)).select("query_id", "doc_id")


@query("r06_snippets")
def _(t):
    hits = retrieval.bm25(t.search_queries, index(t, t.search_queries), k=3)
    return retrieval.snippets(hits, t.search_queries, t.docs)


# every benchmark text and, as a second query, its first sentence
EXACT_Q = "eq AS (SELECT query_id, query FROM search_queries UNION ALL SELECT query_id + 100000, split_part(query, '.', 1) FROM search_queries)"


def exact_queries(t):
    first = t.search_queries.select((F.col("query_id") + 100000).alias("query_id"), F.split_part("query", F.lit("."), F.lit(1)).alias("query"))
    return t.search_queries.unionByName(first)


@query("r13_exact", f"""WITH {TOK}, {EXACT_Q}, {bm25_sql('eq')},
    qt AS (SELECT query_id, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+') AS ts FROM eq),
    t1 AS (SELECT q.query_id, d.id AS doc_id, lower(d.title) AS tl, lower(q.query) AS ql, row_number() OVER (PARTITION BY q.query_id ORDER BY d.year DESC NULLS LAST, d.id) AS rank
           FROM docs d JOIN eq q ON contains(lower(d.title), lower(q.query))),
    a1 AS (SELECT query_id, doc_id, 1 AS tier, CASE WHEN tl = ql THEN 1.0 WHEN starts_with(tl, ql) THEN 0.95 ELSE 0.9 - (rank - 1) * 0.01 END::DOUBLE AS score, rank FROM t1 WHERE rank <= 20),
    joined AS (SELECT doc_id, ' ' || array_to_string(toks, ' ') || ' ' AS s FROM ft),
    ph AS (SELECT DISTINCT query_id, doc_id FROM qt JOIN joined ON contains(s, ' ' || array_to_string(ts, ' ') || ' ') WHERE query_id NOT IN (SELECT query_id FROM a1)),
    a2 AS (SELECT query_id, doc_id, 2 AS tier, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ph JOIN scored USING (query_id, doc_id)),
    al AS (SELECT q.query_id, p.doc_id FROM (SELECT DISTINCT query_id, unnest(ts) AS term FROM qt) q JOIN post p USING (term) JOIN qt USING (query_id)
           WHERE q.query_id NOT IN (SELECT query_id FROM a1) AND q.query_id NOT IN (SELECT query_id FROM a2) GROUP BY q.query_id, p.doc_id, ts HAVING count(*) = len(list_distinct(ts))),
    a3 AS (SELECT query_id, doc_id, 3 AS tier, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al JOIN scored USING (query_id, doc_id))
    SELECT query_id, doc_id, tier, round(score, 6) AS score, rank, ['exact_title_match', 'phrase', 'keyword_and'][tier] AS strategy
    FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3) WHERE rank <= 20""", "docs search_queries")
def _(t):
    q = exact_queries(t)
    return retrieval.exact(q, t.docs, index(t, q)).withColumn("score", F.round("score", 6))


# --- query rewriting -----------------------------------------------------------------
ACR = {"the": ["and the", "for the"], "on": ["upon-on"]}
SYN = {"with": ["by", "from", "in"], "and": ["of"]}


@query("r14_expand_queries", r"""
    WITH n AS (SELECT query_id, trim(regexp_replace(regexp_replace(query, '[^\p{L}\p{N}_\s\-''"]', ' ', 'g'), '\s+', ' ', 'g')) AS normalized FROM search_queries),
    l AS (SELECT *, string_split(lower(normalized), ' ') AS low FROM n),
    e AS (SELECT *, list_contains(low, 'the') OR list_contains(low, 'on') AS hit,
      list_transform(low, lambda w: CASE w WHEN 'the' THEN '(THE OR "and the" OR "for the")' WHEN 'on' THEN '(ON OR "upon on")' ELSE w END) AS terms,
      flatten(list_transform(low, lambda w: CASE w WHEN 'with' THEN ['by', 'from'] WHEN 'and' THEN ['of'] ELSE [] END)) AS syn FROM l)
    SELECT query_id, normalized, CASE WHEN hit THEN array_to_string(terms, ' OR ') ELSE normalized END || CASE WHEN len(syn) > 0 THEN ' ' || array_to_string(syn, ' ') ELSE '' END AS expanded FROM e""",
       "search_queries")
def _(t):
    return rewrite.expand_queries(t.search_queries, acronyms=ACR, synonyms=SYN).select("query_id", "normalized", "expanded")


def vocabulary(t):
    """Frequent terms of the documents in plain letters (the oracle counts edits in bytes)."""
    return textindex.build_index(t.docs, ABSTRACT).terms.filter("df >= 5 AND term RLIKE '^[a-z]+$'")


@query("r15_corrections", r"""
    WITH v AS (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(regexp_extract_all(lower(abstract), '[\p{L}\p{N}]+')) AS term FROM docs) WHERE regexp_full_match(term, '[a-z]+') GROUP BY 1 HAVING count(DISTINCT id) >= 5),
    r AS (SELECT unnest(string_split(trim(regexp_replace(regexp_replace(query, '[^\p{L}\p{N}_\s\-''"]', ' ', 'g'), '\s+', ' ', 'g')), ' ')) AS raw FROM search_queries),
    u AS (SELECT DISTINCT lower(raw) AS word FROM r WHERE NOT (raw = upper(raw) AND lower(raw) <> upper(raw)) AND length(raw) > 2 AND NOT (length(raw) <= 4 AND raw <> lower(raw))
          AND NOT regexp_matches(raw, '\p{N}') AND lower(raw) NOT IN (SELECT term FROM v)),
    c AS (SELECT word, term, df, levenshtein(word, term) AS edits, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, term), df DESC, term) AS n
          FROM u JOIN v ON length(term) > 2 AND levenshtein(word, term) <= 2)
    SELECT word, term, df, edits FROM c WHERE n = 1 AND regexp_full_match(word, '[ -~]+')""", "docs search_queries")
def _(t):
    return rewrite.corrections(t.search_queries, vocabulary(t)).filter("word RLIKE '^[ -~]+$'")


@query("r15_correct_queries")
def _(t):
    out = rewrite.correct_queries(t.search_queries, vocabulary(t))
    return out.select("query_id", "corrected", F.size("corrections").alias("n_corrections"))


# --- ranks and fusion ----------------------------------------------------------------
LISTS = """w01 AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, max(l_extendedprice) AS s1, max(l_quantity) AS s2 FROM lineitem GROUP BY 1, 2),
  l1 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, doc_id) AS rank FROM w01),
  l2 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, doc_id) AS rank FROM w01)"""


def two_lists(t):
    base = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(
        F.max("l_extendedprice").alias("s1"), F.max("l_quantity").alias("s2"))
    one = ranking.ranked(base, ["query_id"], [F.desc("s1"), F.col("doc_id")])
    two = ranking.ranked(base, ["query_id"], [F.desc("s2"), F.col("doc_id")])
    return one.select("query_id", "doc_id", "rank"), two.select("query_id", "doc_id", "rank")


@query("w01_ranked", f"WITH {LISTS} SELECT query_id, doc_id, rank FROM l1")
def _(t):
    return two_lists(t)[0]


@query("w03_min_max", """
    WITH b AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2)
    SELECT query_id, doc_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score_norm
    FROM b WINDOW w AS (PARTITION BY query_id)""")
def _(t):
    base = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(F.max("l_quantity").alias("score"))
    return ranking.min_max(base, ["query_id"]).select("query_id", "doc_id", F.round("score_norm", 6).alias("score_norm"))


@query("w04_first_per_key", """
    SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def _(t):
    from quire.operators.sets import first_per_key
    return first_per_key(t.events, "user_id", ["ts", "event_id"]).select("event_id", "user_id")


@query("w06_section_at", """
    SELECT p.user_id AS doc_id, p.event_id AS pos, (SELECT h.props FROM events h WHERE h.user_id = p.user_id AND h.event_type = 'signup' AND h.event_id <= p.event_id
      ORDER BY h.event_id DESC LIMIT 1) AS section FROM events p WHERE p.event_type <> 'signup'""")
def _(t):
    base = t.events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), "event_type", F.col("props").alias("header"))
    return ranking.section_at(base.filter("event_type <> 'signup'"), base.filter("event_type = 'signup'"))


@query("w07_decayed", f"WITH {LISTS} SELECT query_id, doc_id, round(0.9 - (rank - 1) * 0.01, 6)::DOUBLE AS score FROM l1")
def _(t):
    return two_lists(t)[0].select("query_id", "doc_id", F.round(ranking.decayed(F.col("rank")), 6).alias("score"))


@query("r11_rrf", f"""WITH {LISTS}, u AS (SELECT *, 0 AS n, 0.35 AS w FROM l1 UNION ALL SELECT *, 1, 0.65 FROM l2),
    s AS (SELECT query_id, doc_id, sum(w / (60 + rank)) AS score, min(n * 1000000 + rank) AS seen FROM u GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score, 6)::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS rank FROM s) WHERE rank <= 5""")
def _(t):
    return ranking.rrf(list(two_lists(t)), [0.35, 0.65], limit=5).withColumn("score", F.round("score", 6))


def query_vectors(t):
    """Vector of the document numbered like the query."""
    return t.vectors.join(t.search_queries.select(F.col("query_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding")


NEAR = """near AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q JOIN search_queries s ON s.query_id = q.vec_id CROSS JOIN embeddings v) WHERE score >= {floor})"""
FUSED = """u AS (SELECT query_id, doc_id, rank, 0 AS n, 0.35 AS w FROM words UNION ALL SELECT query_id, doc_id, rank, 1, 0.65 FROM near WHERE rank <= 30),
    s AS (SELECT query_id, doc_id, sum(w / (60 + rank)) AS score, min(n * 1000000 + rank) AS seen FROM u GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score, 6)::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS rank FROM s) WHERE rank <= 10"""


@query("r12_hybrid", f"WITH {TOK}, {bm25_sql('search_queries')}, words AS ({top('scored', 30)}), {NEAR.format(floor=0.2)}, {FUSED}", "docs search_queries")
def _(t):
    out = search.hybrid(t.search_queries, query_vectors(t), index(t, t.search_queries), t.vectors, k=10, min_score=0.2)
    return out.withColumn("score", F.round("score", 6))


# chunks: the label names the paper; the best chunk scores it
CHUNK_NEAR = """cp AS (SELECT q.vec_id AS query_id, v.label || '_' || v.vec_id AS id, v.label AS paper, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q JOIN search_queries s ON s.query_id = q.vec_id CROSS JOIN embeddings v),
    cf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM cp WHERE score >= 0.1) WHERE n <= 30),
    near AS (SELECT query_id, CAST(paper AS BIGINT) AS doc_id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, paper) AS rank FROM cf GROUP BY 1, paper)"""


@query("r12_hybrid_chunks", f"WITH {TOK}, {bm25_sql('search_queries')}, words AS ({top('scored', 30)}), {CHUNK_NEAR}, {FUSED}", "docs search_queries")
def _(t):
    chunks = t.vectors.select(F.concat_ws("_", "label", "id").alias("chunk_id"), F.col("label").cast("long").alias("paper_id"), "embedding")
    out = search.hybrid(t.search_queries, query_vectors(t), index(t, t.search_queries), t.vectors, chunks=chunks, k=10, min_score=0.1)
    return out.withColumn("score", F.round("score", 6))


@query("r18_search_keyword", f"WITH {TOK}, {bm25_sql('search_queries')} SELECT query_id, doc_id, score, rank, 'keyword' AS strategy FROM ({top('scored', 5)})", "docs search_queries")
def _(t):
    out = search.search(t.search_queries, "keyword", docs=t.docs, index=index(t, t.search_queries), k=5)
    return out.select("query_id", "doc_id", "score", "rank", F.array_join("strategy", ",").alias("strategy"))


@query("r18_search_hybrid", f"WITH {TOK}, {bm25_sql('search_queries')}, words AS ({top('scored', 30)}), {NEAR.format(floor=0.2)}, f AS ({FUSED.replace('u AS', 'WITH u AS', 1)}) SELECT *, 'keyword,semantic' AS strategy FROM f", "docs search_queries")
def _(t):
    out = search.search(t.search_queries, "hybrid", docs=t.docs, index=index(t, t.search_queries), vectors=t.vectors, query_vectors=query_vectors(t), k=10, min_score=0.2)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", F.array_join("strategy", ",").alias("strategy"))


@query("r18_result_rows", f"WITH {TOK}, {bm25_sql('search_queries')} SELECT s.query_id, s.doc_id, s.rank, round(s.score, 3) AS score, d.title, substring(d.abstract, 1, 200) AS head FROM ({top('scored', 5)}) s JOIN docs d ON d.id = s.doc_id", "docs search_queries")
def _(t):
    hits = search.search(t.search_queries, "keyword", docs=t.docs, index=index(t, t.search_queries), k=5)
    out = search.result_rows(hits, t.docs)
    return out.select("query_id", F.col("id").alias("doc_id"), "rank", "score", "title", F.substring("abstract", 1, 200).alias("head"))


@query("r16_smart")
def _(t):
    return search.smart(t.search_queries, query_vectors(t), index(t), t.vectors, k=10, min_score=0.2).withColumn("score", F.round("score", 6))


@query("r18_search_semantic_fallback", f"""WITH {TOK}, {bm25_sql('search_queries')}
    SELECT query_id, doc_id, score, rank, 'keyword' AS strategy, 'no vectors, keyword search used' AS fallback FROM ({top('scored', 5)})""", "docs search_queries")
def _(t):
    out = search.search(t.search_queries, "semantic", docs=t.docs, index=index(t, t.search_queries), k=5)
    return out.withColumn("strategy", F.array_join("strategy", ","))


@query("r18_search_semantic", f"""WITH {NEAR.format(floor=0.2)} SELECT query_id, doc_id, score, rank, 'semantic' AS strategy FROM near WHERE rank <= 5""", "search_queries")
def _(t):
    out = search.search(t.search_queries, "semantic", docs=t.docs, index=None, vectors=t.vectors, query_vectors=query_vectors(t), k=5, min_score=0.2)
    return out.withColumn("strategy", F.array_join("strategy", ",")).drop("fallback")
