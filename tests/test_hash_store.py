"""The growing hash store against a plain set."""

import random

import pytest
from pyspark.sql import functions as F

from quire.streaming import hash_store

SCHEMA = "id long, text string, ts timestamp"


def rows(r, n, pool):
    return [(r.randint(0, 10 ** 9), r.choice(pool), None) for _ in range(n)]


def test_growing_store_equals_a_set(spark, tmp_path):
    r, root = random.Random(4), str(tmp_path / "s")
    pool = [f"text {i}" for i in range(200)] + ["", None]
    seen, expected = set(), []
    for b in range(6):
        batch = rows(r, 60, pool)
        df = spark.createDataFrame(batch, SCHEMA)
        hash_store.take_in(spark, root, df, b, buckets=4, fan=2)
        new = {(t or "") for _, t, _ in batch} - seen
        seen |= new
        expected += new
        hash_store.take_in(spark, root, spark.createDataFrame(rows(r, 60, pool), SCHEMA), b, buckets=4, fan=2)  # a replay, even with other rows, does nothing
    got = [(x["text"] or "") for x in hash_store.documents(spark, root, df.schema).collect()]
    assert sorted(got) == sorted(expected) and len(got) == len(set(got))
    _, live = hash_store.manifest(spark, root)
    assert len(live) < 6 and sum(n for _, n in live) == len(seen)


def test_filters_decide_which_buckets_are_read(spark, tmp_path):
    root = str(tmp_path / "s")
    df = lambda texts: spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    assert hash_store.take_in(spark, root, df([f"a{i}" for i in range(300)]), 0) == []
    assert hash_store.take_in(spark, root, df([f"b{i}" for i in range(50)]), 1) == []  # all new: nothing is read
    read = hash_store.take_in(spark, root, df(["a7", "new"]), 2)
    assert len(read) == 1
    assert {x["text"] for x in hash_store.documents(spark, root, df([]).schema, 2).collect()} == {"new"}


def test_merged_filters_equal_those_of_the_whole(spark, tmp_path):
    h = spark.createDataFrame([(f"h{i}", i % 3) for i in range(100)], "hash string, bucket int")
    words = lambda df: hash_store._probes(df, 1 << 10).groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))
    a, b = words(h.filter("bucket = 0 OR hash < 'h5'")), words(h)
    merged = a.unionByName(words(h.filter("hash >= 'h5'"))).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, b.collect()))
    assert hash_store.maybe_known(h, b, 1 << 10).count() == 100


def test_order_crash_and_stream(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    batch = spark.sql("SELECT * FROM VALUES (1L, 'x', TIMESTAMP'2024-01-02'), (2L, 'x', TIMESTAMP'2024-01-01'), (3L, 'x', NULL) AS t(id, text, ts)")
    commit = hash_store.commit
    monkeypatch.setattr(hash_store, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        hash_store.take_in(spark, root, batch, 0)
    assert hash_store.documents(spark, root, batch.schema).count() == 0
    monkeypatch.setattr(hash_store, "commit", commit)
    hash_store.take_in(spark, root, batch, 0)
    assert [x["id"] for x in hash_store.documents(spark, root, batch.schema).collect()] == [2]
    batch.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    hash_store.run(s, root, str(tmp_path / "state"), first_batch=1).awaitTermination()
    assert hash_store.documents(spark, root, batch.schema).count() == 1
