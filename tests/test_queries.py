"""Registered queries on small tables, against their SQL on DuckDB."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.catalog import load
from quire.operators import enrich


def both(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL; a table may be written as several files."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    queries, sql = load()
    out = queries[name](spark, str(folder))
    cols = ", ".join(out.columns)
    return sorted(map(tuple, out.collect())), sorted(con.sql(f"SELECT {cols} FROM ({sql[name]})").fetchall())


def test_halves_of_chunk_counts_round_as_in_sql(spark, tmp_path):
    day = datetime.datetime(1998, 1, 1)
    rows = [(i, i, "F", 25000.0 * i, day, "3-MEDIUM") for i in range(1, 12)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    got, want = both(spark, tmp_path, "p04_processing_queue", orders=orders)
    assert got == want and (1, "complete", 0) in got and (5, "complete", 2) in got


@pytest.mark.parametrize("t", [0.92, 0.9])
def test_length_windows_are_those_of_sql(spark, t):
    low, high = enrich.length_window(F.col("n"), t)
    got = spark.range(1, 3000).select(F.col("id").cast("int").alias("n")).select("n", low, high).orderBy("n").collect()
    up = f"{2 - t:.2f}"
    want = duckdb.sql(f"SELECT n, greatest(CAST(trunc(n * {t} / {up}) AS INT) - 10, 1), CAST(trunc(n * {up} / {t}) AS INT) + 10 FROM range(1, 3000) t(n) ORDER BY n").fetchall()
    assert [tuple(r) for r in got] == want


def test_streams_read_tables_of_many_files(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 15).cast("string")).alias("text"), F.lit(6).cast("long").alias("n_chars"))
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    got, want = both(spark, tmp_path, "t02_streaming_ingest", documents=docs.repartition(3), labels=labels)
    assert got == want == [(14, 14)]


def test_text_quality_of_odd_texts(spark, tmp_path):
    """empty and missing texts, vertical tabs between words, a dotted capital I."""
    texts = ["", None, " ", "COPYR\u0130GHT NOTICE", "All Rights Reserved", "long word\x0b" * 600, "long word " * 600, "longer words " * 240, "a" * 1001, "a\x1cb\u2003c\x85" * 900, "\u0130" * 5001]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts * 2)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    got, want = both(spark, tmp_path, "q07_text_quality", documents=docs, labels=labels)
    assert got == want and {r[2] for r in got} == {"good", "suspect", "contaminated"}
