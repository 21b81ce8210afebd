"""Mergeable sketches against exact reports."""

import random

from pyspark.sql import functions as F

from quire.operators import sketches


def test_merged_parts_equal_the_whole(spark, tmp_path):
    r = random.Random(1)
    rows = [(i % 7, r.choice(["a", "b"]), r.randrange(4000), r.gauss(100, 20)) for i in range(20000)] + [(0, "c", None, None)]
    df = spark.createDataFrame(rows, "batch int, section string, paper_id long, words double").repartition(5)
    how = dict(distinct=["paper_id"], measures=["words"])
    whole = {x["section"]: x for x in sketches.estimates(sketches.sketch(df, ["section"], **how)).collect()}
    path = str(tmp_path / "s")
    for b in range(7):
        sketches.append(df.filter(F.col("batch") == b), path, str(b), ["section"], **how)
    sketches.append(df.filter("batch = 3"), path, "3", ["section"], **how)  # a replay
    stored = spark.read.parquet(path)
    merged = {x["section"]: x for x in sketches.estimates(sketches.merge(stored, ["section"])).collect()}
    exact = {x["section"]: x for x in df.groupBy("section").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("d"), F.percentile("words", 0.5).alias("p50"), F.percentile("words", 0.9).alias("p90")).collect()}
    for s, e in exact.items():
        m, w = merged[s], whole[s]
        assert m["n"] == e["n"] == w["n"] and m["distinct_paper_id"] == w["distinct_paper_id"]
        assert abs(m["distinct_paper_id"] - e["d"]) <= 0.05 * e["d"]
        if s != "c":
            assert abs(m["words_p50"] - e["p50"]) < 2 and abs(m["words_p90"] - e["p90"]) < 3
    assert merged["c"]["distinct_paper_id"] == 0 and merged["c"]["words_p50"] is None
    assert sketches.estimates(sketches.merge(stored, [])).first()["n"] == 20001
    assert sketches.sketch(df.limit(0), ["section"], **how).count() == 0


def test_one_task_estimates_as_merged_parts(spark):
    rows = spark.range(60000).select((F.col("id") % 5).alias("section"), F.xxhash64("id").alias("paper_id")).coalesce(1)
    rows = rows.filter("section < 4 OR paper_id % 16 = 0")
    whole = sketches.estimates(sketches.sketch(rows, ["section"], distinct=["paper_id"]))
    parts = sketches.sketch(rows.withColumn("bucket", F.pmod("paper_id", F.lit(16))), ["section", "bucket"], distinct=["paper_id"])
    merged = sketches.estimates(sketches.merge(parts, ["section"]))
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in merged.collect()}
