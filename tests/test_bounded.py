"""Bounded BM25 against the plan that scores every posting."""

import random

import pytest

from quire.operators import bounded, retrieval, textindex


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    pick = lambda n: " ".join(vocab[min(299, int(r.expovariate(0.02)))] for _ in range(n))
    rows = [(i, pick(r.randint(0, 6)), pick(r.choice([0, 5, 20, 200])), 1990 + i % 20) for i in range(400)]
    rows += [(400 + i, "same title", "same words here", 2000) for i in range(30)] + [(500, None, None, None)]
    docs = spark.createDataFrame(rows, "id long, title string, abstract string, year int").repartition(4)
    queries = spark.createDataFrame([(i, pick(r.randint(1, 12))) for i in range(15)] + [(90, "same words"), (91, "nowhere"), (92, ""), (93, None)], "query_id long, query string")
    return docs, queries


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("block_docs,first,k", [(4, 2, 5), (1, 1, 10), (64, 8, 3)])
def test_equals_the_whole_scoring(corpus, block_docs, first, k):
    docs, queries = corpus
    index = textindex.build_index(docs)
    blocked = bounded.stored_blocked(index, block_docs)
    assert rows(bounded.bm25(queries, blocked, k=k, first=first)) == rows(retrieval.bm25(queries, index, k=k))


def test_years_and_other_parameters(corpus):
    docs, queries = corpus
    index = textindex.build_index(docs)
    blocked = bounded.stored_blocked(index)
    how = dict(docs=docs, year_min=1995, year_max=2003, k=4, k1=2.0, b=0.3)
    assert rows(bounded.bm25(queries, blocked, first=2, **how)) == rows(retrieval.bm25(queries, index, **how))


def test_bounds_do_not_grow_with_the_documents(corpus, monkeypatch):
    docs, queries = corpus
    monkeypatch.setattr(bounded, "BLOCKS", 20)
    index = textindex.build_index(docs)
    blocked = bounded.stored_blocked(index)
    classes = index.docs.select(bounded._length_class(index.docs["dl"])).distinct().count()
    assert blocked.blocks.select("block").distinct().count() <= 20 + classes
    assert rows(bounded.bm25(queries, blocked, k=5, first=2)) == rows(retrieval.bm25(queries, index, k=5))


def test_fewer_postings_are_read(corpus):
    docs, queries = corpus
    blocked = bounded.stored_blocked(textindex.build_index(docs), 1)
    got = bounded.postings_read(queries, blocked, k=3, first=8).toPandas()
    assert (got["postings_read"] <= got["postings"]).all() and got["postings_read"].sum() < 0.7 * got["postings"].sum()


def test_empty_index(corpus):
    docs, queries = corpus
    blocked = bounded.stored_blocked(textindex.build_index(docs.limit(0)))
    assert bounded.bm25(queries, blocked, k=3).count() == 0
