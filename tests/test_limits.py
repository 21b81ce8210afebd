"""No hidden limits: depths, lengths, late versions, substrings and bounds against brute force."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quire.functions.similarity import may_match
from quire.operators import graph, listing, structure, vectors
from quire.streaming import status_machine


def test_chain_goes_as_deep_as_asked(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "citing long, cited long")
    rows = graph.chain(edges, spark.createDataFrame([(0,)], "id long"), depth=5).collect()
    assert sorted((r.level, r.paper_id) for r in rows) == [(k, k) for k in range(1, 6)]
    assert max(r.level for r in graph.chain(edges, spark.createDataFrame([(0,)], "id long"), depth=50).collect()) == 6


def test_closure_of_a_deep_tree_and_of_a_cycle(spark):
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)], "id long, parent_id long")
    rows = graph.collection_closure(tree).collect()
    assert len(rows) == 70 * 71 // 2 and all(r.depth == r.id - r.root_id for r in rows)
    ring = spark.createDataFrame([(0, 2), (1, 0), (2, 1), (3, 2)], "id long, parent_id long")
    got = {(r.root_id, r.id): r.depth for r in graph.collection_closure(ring).collect()}
    assert got[0, 3] == 3 and got[2, 3] == 1 and got[0, 0] == 0 and len(got) == 13


def test_external_works_with_one_beginning_stay_apart(spark):
    papers = spark.createDataFrame([(1, "10.1/a", "Seed")], "id long, doi string, title string")
    name = "A very long title that goes on and on, part "
    links = spark.createDataFrame([(1, "reference", None, name + n, 2000) for n in ("I", "II")], "paper_id long, relation string, doi string, title string, year int")
    nodes, _ = graph.build_graph(spark.createDataFrame([(1,)], "id long"), links, papers, include_external=True)
    assert nodes.filter("type = 'external'").count() == 2


def test_substrings_of_any_length(spark):
    r = random.Random(3)
    texts = [(i, "".join(r.choice("abé ") for _ in range(r.randrange(0, 9)))) for i in range(60)]
    asks = [(i, q) for i, q in enumerate(["", "a", "é", "ab", " b", "aba", "éab", "abab", "zzz"])]
    rows = listing.substring_join(spark.createDataFrame(texts, "id long, _text string"), spark.createDataFrame(asks, "query_id long, _query string")).collect()
    assert sorted((x.id, x.query_id) for x in rows) == sorted((i, k) for i, t in texts for k, q in asks if q in t)


def test_bound_keeps_every_pair_that_the_ratio_accepts(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 25))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words] + [(w, w[:3] + w[4:]) for w in words]
    kept = {(x.a, x.b) for x in spark.createDataFrame(pairs, "a string, b string").filter(may_match(F.col("a"), F.col("b"), 0.2)).collect()}
    assert all(p in kept for p in pairs if SequenceMatcher(None, *p).ratio() >= 0.8)
    assert len(kept) < len(set(pairs)) / 2


def test_vectors_with_named_ids_in_small_blocks(spark):
    r = random.Random(5)
    rows = [(f"{i}_0", [r.gauss(0, 1) for _ in range(8)]) for i in range(40)]
    v = spark.createDataFrame(rows, "id string, embedding array<double>")
    one = vectors.similar_papers(v, 3).orderBy("query_id", "rank").collect()
    q = v.withColumnRenamed("id", "query_id")
    assert vectors.knn(q, v, 3, no_self=True, block=7).orderBy("query_id", "rank").collect() == one and len(one) == 120


def test_short_references_on_request(spark):
    docs = spark.createDataFrame([(1, "x\nReferences\n[1] A full reference with a long text, 2001.\n[2] short\n")], "doc_id long, text string")
    assert [r.number for r in structure.extract_references(docs).collect()] == [1]
    assert [(r.number, r.short) for r in structure.extract_references(docs, keep_short=True).orderBy("number").collect()] == [(1, False), (2, True)]


def test_stuck_documents_time_out(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [(1, "2024-01-01 00:00:00", "pending"), (1, "2024-01-01 00:01:00", "needs_pdf")]
        later = [(2, "2024-01-02 00:00:00", "pending")]
        for n, part in enumerate((rows, later)):
            df = spark.createDataFrame(part, "id long, ts string, status string").withColumn("ts", F.to_timestamp("ts"))
            df.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        s = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = (status_machine.status_stream(s, late="1 second", stuck_ms=60_000).writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(key, old)
    got = spark.read.parquet(f"{tmp_path}/out").filter("id = 1").orderBy("ts").collect()
    assert [r.outcome for r in got] == ["moved", "moved", "timed_out"] and got[-1].new_status == "failed"


def test_chains_repeat_and_broadcast_no_seed(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 5, raising=False)
    edges = spark.createDataFrame([(1, k) for k in range(2, 20)] + [(k, k + 100) for k in range(2, 20)] + [(30, 1)], "citing long, cited long")
    seeds = spark.createDataFrame([(1,), (30,)], "id long")
    out = graph.chain(edges, seeds, depth=3)
    got = {(r.seed_id, r.level, r.paper_id) for r in out.collect()}
    fan = {k for k in range(2, 20)}
    assert got == {(1, 1, k) for k in fan} | {(1, 2, k + 100) for k in fan} | {(30, 1, 1)} | {(30, 2, k) for k in fan} | {(30, 3, k + 100) for k in fan}
    # the only broadcasts are of the hot papers
    plan = graph.chain(edges, seeds, depth=2)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [from_id" in plan and "BroadcastHashJoin [from_id#" in plan
    assert not any("salt" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
