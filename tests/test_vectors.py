"""Approximate vector search against the exact plan."""

import numpy as np
import pytest

from quire.operators import vector_index as vi, vectors


def table(spark, rows, extra="", name="id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>{extra}")


@pytest.fixture(scope="module")
def cloud(spark):
    """Forty groups of vectors, one of them a third of all rows, and exact copies."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    group = np.where(r.random(1500) < 0.33, 0, r.integers(0, 40, 1500))
    x = centres[group] + 0.35 * r.normal(size=(1500, 16))
    x[20:40] = x[20]
    return table(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)]).repartition(5)


def hits(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


def test_all_cells_equal_the_exact_plan(cloud):
    q = cloud.filter("id % 20 = 0").selectExpr("id AS query_id", "embedding")
    index = vi.build(cloud, 16)
    assert hits(vi.probe(q, index, 7, probes=16, block=100)) == hits(vectors.knn(q, cloud, 7))
    assert hits(vi.probe(q, index, 7, probes=16, min_score=0.5, no_self=True)) == hits(vectors.knn(q, cloud, 7, min_score=0.5, no_self=True))


def test_recall_and_scores_with_few_cells(cloud, spark, tmp_path):
    q = cloud.filter("id % 20 = 0").selectExpr("id AS query_id", "embedding")
    vi.save(vi.build(cloud, 32), str(tmp_path / "i"))
    index = vi.load(spark, str(tmp_path / "i"))
    found, exact = vi.probe(q, index, 10, probes=8), vectors.knn(q, cloud, 10)
    got = vi.recall(found, exact).toPandas()
    assert len(got) == 75 and got["recall"].mean() >= 0.9
    scores = {(a, c): d for a, _, c, d in hits(exact)}
    assert all(d == scores[a, c] for a, _, c, d in hits(found) if (a, c) in scores)  # re-scored exactly
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_vector_in_one_cell_and_appended_ones_found(cloud, spark, tmp_path):
    index = vi.build(cloud.filter("id < 1400"), 16)
    more = vi.extend(index, cloud.filter("id >= 1400"))
    assert more.vectors.count() == 1500 == more.vectors.select("id").distinct().count()
    vi.save(index, str(tmp_path / "i"))
    vi.save(vi.VectorIndex(vi.extend(vi.VectorIndex(index.vectors.limit(0), index.centres), cloud.filter("id >= 1400")).vectors, index.centres), str(tmp_path / "i"), "append")
    again = vi.load(spark, str(tmp_path / "i"))
    q = cloud.filter("id >= 1490").selectExpr("id AS query_id", "embedding")
    assert hits(vi.probe(q, again, 3, probes=16)) == hits(vectors.knn(q, cloud, 3))


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 1.0]), (1, [1.0, 0.0]), (7, [None, 1.0])]
    v = table(spark, [(*r, "x") for r in rows], ", cell_name string")
    index = vi.build(v, 4)
    assert sorted(r["id"] for r in index.vectors.collect()) == [1, 1, 3, 6]
    got = hits(vi.probe(v.selectExpr("id AS query_id", "embedding"), index, 2, probes=4))
    assert {g[0] for g in got} == {1, 3, 6}
    assert [g for g in got if g[0] == 6] == [(6, 1, 6, 1.0), (6, 2, 1, 0.0)]
    nothing = vi.build(v.limit(0), 4)
    assert vi.probe(v.selectExpr("id AS query_id", "embedding"), nothing, 2).count() == 0


def test_chunks(cloud, spark):
    chunks = cloud.selectExpr("id AS chunk_id", "id div 4 AS paper_id", "id AS chunk_index", "'s' AS section", "'t' AS text", "embedding")
    q = cloud.filter("id % 100 = 0").selectExpr("id AS query_id", "embedding")
    index = vi.build(chunks.selectExpr("chunk_id AS id", "embedding"), 8)
    cols = ["query_id", "paper_id", "score", "rank"]
    assert sorted(map(tuple, vi.chunk_probe(q, chunks, index, 3, probes=8).select(*cols).collect())) == sorted(map(tuple, vectors.chunk_knn(q, chunks, 3).select(*cols).collect()))


def test_blocks_bound_memory_and_do_not_repeat_rows():
    """A small block is multiplied within a task; a product of many queries and vectors is never held whole."""
    import tracemalloc

    assert vectors._parts(3000, 100) == 1 and vectors._parts(9000, 100) == 3 == vectors._parts(9000, vectors.BLOCK) and vectors._parts(9000, 9000) == 1
    r = np.random.default_rng(1)
    x, ids = vectors._unit(r.normal(size=(3000, 8))), np.arange(3000)
    tracemalloc.start()
    got = vectors._best(ids, x, ids, x, 5, None, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 15000 and peak < 48 << 20  # the whole product takes 72 MB, and its order as much


def test_only_asking_vectors_get_neighbours(cloud):
    v = cloud.select("id", "embedding")
    whole = [h for h in hits(vectors.similar_papers(v, 3, min_score=0.3)) if h[0] % 20 == 0]
    assert whole == hits(vectors.similar_papers(v, 3, min_score=0.3, ask="id % 20 = 0"))
    index = vi.build(v, 8)
    assert whole == hits(vi.neighbours(index, 3, probes=8, min_score=0.3, ask="id % 20 = 0"))


@pytest.mark.parametrize("floor,no_self", [(None, False), (0.2, True), (None, True)])
def test_columns_in_slices_keep_the_best_and_their_ties(floor, no_self):
    r = np.random.default_rng(5)
    x = r.normal(size=(9000, 4)).round(1)
    x[100:5000:7] = x[3]  # copies in several slices
    x = vectors._unit(x)
    ids = r.permutation(9000)
    asked = np.concatenate((np.arange(40), [107, 8999]))
    got = vectors._best(ids[asked], x[asked], ids, x, 6, floor, no_self, 32)
    sims = np.round(x[asked] @ x.T, 6)
    for row, a in enumerate(asked):
        ok = np.flatnonzero(((ids != ids[a]) | (not no_self)) & (sims[row] >= (-2 if floor is None else floor)))
        want = sorted((-sims[row, c], ids[c]) for c in ok)[:6]
        mine = got[got["query_id"] == ids[a]]
        assert list(zip(-mine["score"], mine["id"])) == want


def test_large_tables_repeat_their_rows_less():
    """six million vectors were dealt into 1,465 parts, each of which repeated the other side."""
    assert vectors._parts(60_000, 100) == 15 and vectors._parts(500_000, 100) == 16 and vectors._parts(6_000_000, 100) == 184


@pytest.mark.parametrize("name", ["r09_similar_papers", "r09_similar_papers_blocks", "r09_similar_without_vector", "r10_suggest_citations", "r09_neighbours_probed", "r08_chunk_probe"])
def test_every_vector_asks(spark, tmp_path, name):
    """The queries took only ids divisible by 20."""
    from test_queries import both

    r = np.random.default_rng(4)
    x = r.normal(size=(70, 8)) + 0.8 * r.normal(size=(7, 8))[np.arange(70) % 7]
    v = spark.createDataFrame([(i, [float(f) for f in row], i % 7) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 70, 3)], "doc_id long, quality int, toxic int")
    got, want = both(spark, tmp_path, name, embeddings=v, labels=labels)
    assert {row[0] for row in got} >= set(range(60, 70)) and len(got) == len(want)
    assert all(a == pytest.approx(b, abs=2e-6) for a, b in zip(sorted(got, key=str), sorted(want, key=str)))
