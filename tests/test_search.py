import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import ranking, retrieval, rewrite, search, textindex, vectors

TITLES = ["Atomic layer deposition of alumina", "Corrosion of steel in seawater", "Stress cracking in pipes",
          "Molecular layer processes MLD", "ALD reactors", "Layer growth atomic"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "", 2000 + i) for i, t in enumerate(TITLES)], "id long, title string, abstract string, year int").cache()


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


@pytest.mark.parametrize("query,n", [("corrosion cracking", 2), ("ald OR mld", 2), ("corrosion AND cracking", 0), ('"atomic layer"', 1), ("layer NOT mld", 2)])
def test_operators(spark, docs, query, n):
    assert retrieval.boolean_match(queries(spark, query), textindex.build_index(docs)).count() == n


def test_operator_words_inside_words_do_not_count(one):
    assert one(retrieval.query_mode(F.lit("corrosion brand"))) == "any"


def test_bm25_matches_formula(spark, docs):
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(queries(spark, "layer atomic steel"), textindex.build_index(docs), k=None).collect()}
    toks = [re.findall(r"\w+", t.lower()) for t in TITLES]
    avg = sum(map(len, toks)) / len(toks)
    for d, words in enumerate(toks):
        want = 0.0
        for t in ("layer", "atomic", "steel"):
            f = 10.0 * words.count(t)
            df = sum(t in w for w in toks)
            if f:
                want += max(math.log((len(toks) - df + .5) / (df + .5)), 1e-6) * f * 2.2 / (f + 1.2 * (.25 + .75 * len(words) / avg))
        assert got.get((0, d), 0.0) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("docs_at_once,asked", [(4096, 256), (40, 3)])
def test_bm25_in_parts_equals_the_pairs(spark, monkeypatch, docs_at_once, asked):
    monkeypatch.setattr(retrieval, "DOCS", docs_at_once)
    monkeypatch.setattr(retrieval, "ASKED", asked)
    r = random.Random(6)
    pick = lambda n: " ".join(f"w{int(r.expovariate(0.05))}" for _ in range(n))
    rows = [(f"d{i}", pick(3), pick(r.choice([0, 5, 40]))) for i in range(300)] + [(f"x{i}", "same title", "same words w1") for i in range(60)] + [("none", None, None)]
    index = textindex.build_index(spark.createDataFrame(rows, "id string, title string, abstract string"))
    asks = spark.createDataFrame([(i, pick(5)) for i in range(12)] + [(50, "same words"), (51, "nowhere"), (52, None), (None, "w1 same")], "query_id int, query string")
    key = lambda df: sorted((str(x.query_id), x.rank, x.doc_id, x.score) for x in df.collect())
    assert key(retrieval.bm25(asks, index, k=7)) == key(retrieval.bm25(asks, index, k=None).filter("rank <= 7"))


def test_bm25_shuffles_no_row_per_query_and_document(spark):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    r = random.Random(7)
    rows = [(i, " ".join(f"w{x}" for x in r.sample(range(12), 6)), "") for i in range(3000)]
    index = textindex.build_index(spark.createDataFrame(rows, "id long, title string, abstract string"))
    asks = spark.createDataFrame([(i, " ".join(f"w{x}" for x in r.sample(range(12), 4))) for i in range(100)], "query_id long, query string")
    before = written()
    assert retrieval.bm25(asks, index, k=10).count() == 1000
    assert written() - before < 1_500_000  # 300,000 pairs have a score


def test_rounding_is_sparks(spark):
    x = [0.0000005, 0.0000015, 1.0000025, 12.3456785, 2.675, 0.1234564999999, 7.0000004999999999, 3.3e-7]
    want = [v[0] for v in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert retrieval._rounded(np.array(x)).tolist() == want


def test_years_limit_hits_not_statistics(spark, docs):
    idx = textindex.build_index(docs)
    every = retrieval.bm25(queries(spark, "layer"), idx, k=None)
    some = retrieval.bm25(queries(spark, "layer"), idx, docs=docs, year_min=2003, k=None)
    assert {r.doc_id for r in some.collect()} == {3, 5}
    assert some.drop("rank").exceptAll(every.drop("rank")).count() == 0


def test_stemmed_index_finds_variants(spark, docs):
    idx = textindex.build_index(docs, stemmed=True)
    assert {r.doc_id for r in retrieval.any_terms(queries(spark, "crack reactor layers"), idx).collect()} == {0, 2, 3, 4, 5}


def test_index_survives_storage(spark, docs, tmp_path):
    idx = textindex.build_index(docs)
    textindex.save_index(idx, str(tmp_path / "i"))
    again = textindex.load_index(spark, str(tmp_path / "i"))
    q = queries(spark, "atomic layer")
    assert retrieval.bm25(q, idx).collect() == retrieval.bm25(q, again).collect()


def test_snippets_mark_and_cut(spark):
    text = " ".join(f"w{i}" for i in range(200)) + " Target, here " + " ".join(f"v{i}" for i in range(200))
    d = spark.createDataFrame([(1, "A target title", text)], "id long, title string, abstract string")
    r = retrieval.snippets(spark.createDataFrame([(0, 1)], "query_id long, doc_id long"), queries(spark, "target"), d).first()
    assert r.title_snippet == "A <mark>target</mark> title"
    assert "<mark>Target,</mark>" in r.abstract_snippet and r.abstract_snippet.startswith("...") and r.abstract_snippet.endswith("...")


def test_exact_keeps_first_tier(spark, docs):
    out = retrieval.exact(queries(spark, "ald reactors", "atomic layer", "growth layer", "steel corrosion"), docs, textindex.build_index(docs)).collect()
    assert {(r.query_id, r.tier) for r in out} == {(0, 1), (1, 1), (2, 3), (3, 3)}
    assert next(r.score for r in out if r.query_id == 0) == 1.0


def test_rrf_ties_keep_first_list(spark):
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "query_id long, doc_id string, rank int")
    b = spark.createDataFrame([(0, "z", 1), (0, "y", 2)], "query_id long, doc_id string, rank int")
    assert [r.doc_id for r in ranking.rrf([a, b]).orderBy("rank").collect()] == ["y", "x", "z"]


def test_min_max_of_constant_list_is_one(spark):
    df = spark.createDataFrame([(0, 5.0), (0, 5.0), (1, 1.0), (1, 3.0)], "q long, score double")
    assert sorted(r.score_norm for r in ranking.min_max(df, ["q"]).collect()) == [0.0, 1.0, 1.0, 1.0]


def test_expansion_never_narrows(spark):
    r = rewrite.expand_queries(queries(spark, "ALD film growth!")).first()
    assert r.expanded == '(ALD OR "atomic layer deposition") OR film OR growth layer coating deposition synthesis'
    assert r.acronyms == ["ALD -> atomic layer deposition"]


def test_correction_skips_and_fixes(spark):
    vocab = spark.createDataFrame([("corrosion", 9), ("corrosive", 2), ("steel", 5)], "term string, df long")
    out = {r.query_id: r.corrected for r in rewrite.correct_queries(queries(spark, "corosion steel", "GaAs ALD ald TiO2x stel", "zzzzzzzz"), vocab).collect()}
    assert out == {0: "corrosion steel", 1: "GaAs ALD ald TiO2x steel", 2: "zzzzzzzz"}


def test_deletions_find_every_near_word(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(80)})
    vocab, probes = words[:50], words[50:]
    lev = lambda a, b: _lev(a, b)
    got = {r.word: (r.edits, r.term) for r in rewrite.corrections(queries(spark, " ".join(probes)), spark.createDataFrame([(w, 1) for w in vocab], "term string, df long")).collect()}
    for p in probes:
        near = sorted((lev(p, v), v) for v in vocab if lev(p, v) <= 2)
        assert got.get(p) == (near[0] if near else None)


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("floor", [None, 0.3])
def test_blocks_equal_scan(spark, floor, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 8))
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(scale=.4, size=8)]) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = v.select(F.col("id").alias("query_id"), "embedding")
    a = sorted(map(tuple, vectors.knn(q, v, 5, min_score=floor, no_self=True).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 40)
    b = sorted(map(tuple, vectors.knn(q, v, 5, min_score=floor, no_self=True).collect()))
    assert a == b and len(a) > 1000


def test_search_modes(spark, docs):
    idx = textindex.build_index(docs)
    out = search.search(queries(spark, "atomic"), "semantic", docs=docs, index=idx).first()
    assert out.fallback and out.strategy == ["keyword"]
    with pytest.raises(ValueError):
        search.search(queries(spark, "x"), "odd", docs=docs, index=idx)


def test_no_cartesian_product(spark, docs):
    idx = textindex.build_index(docs)
    for df in (retrieval.bm25(queries(spark, "a b"), idx), retrieval.phrase_match(queries(spark, "a b"), idx)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_postings_are_made_in_pieces(spark, docs):
    """A batch is cut at a number of tokens, so what a task holds does not follow the batch; postings stay the same."""
    import pyarrow as pa

    lists = pa.array([["a", "b"], None, ["c"] * 5, [], ["a"]])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([2, 0, 5, 0, 1], pa.int32()), lists], ["doc_id", "dl", "tokens_0"])
    parts = list(textindex._pieces(batch, 1, 3))
    assert [p.column("doc_id").to_pylist() for p in parts] == [[0, 1], [2], [3, 4]]
    whole = textindex._count_terms(batch, {"t": 1.0}, False).to_pylist()
    assert [r for p in parts for r in textindex._count_terms(p, {"t": 1.0}, False).to_pylist()] == whole
