import pytest
from pyspark.sql import functions as F

from quire.operators import changes, enrich, listing, quality, reports, sets
from quire.plans import queues
from quire.sources import exports, projects, refmanager, vectorstore
from quire.sources.library import read_library
from quire.streaming import index_maintenance, ingest, status_machine


def test_pages_never_repeat_a_paper(spark):
    papers = spark.createDataFrame([(i, 2020, "unread", i) for i in range(7)], "id long, year int, read_status string, date_added int")
    bridge = spark.createDataFrame([(i, a) for i in range(7) for a in (1, 2)], "paper_id long, author_id long")
    authors = spark.createDataFrame([(1, "Ann Lee"), (2, "Bob Lee")], "id long, name string")
    pages = [[r.id for r in listing.list_papers(papers, author="lee", paper_authors=bridge, authors=authors, offset=o, limit=3).collect()] for o in (0, 3, 6)]
    assert [len(p) for p in pages] == [3, 3, 1] and sum(pages, []) == [6, 5, 4, 3, 2, 1, 0]


def test_queue_puts_unrated_last(spark):
    papers = spark.createDataFrame([(1, None, 9), (2, 3, 1), (3, 5, 1)], "id long, rating int, date_added int").withColumn("read_status", F.lit("unread"))
    assert [r.id for r in listing.reading_queue(papers, limit=9).collect()] == [3, 2, 1]


def test_null_identifiers_are_never_duplicates(spark):
    a = spark.createDataFrame([("d1", 1), (None, 2)], "doi string, ordinal int")
    b = spark.createDataFrame([("d1", 3), (None, 4)], "doi string, ordinal int")
    assert sorted(r.ordinal for r in sets.union_results([a, b]).collect()) == [1, 2, 4]


def test_coverage_of_an_empty_library(spark):
    none = spark.createDataFrame([], "id long, abstract string")
    ids = spark.createDataFrame([], "paper_id long")
    r = reports.extraction_coverage(none, ids, ids).first()
    assert (r.total, r.coverage_percent) == (0, 100.0)


def test_health(spark):
    p = spark.createDataFrame([(1,), (2,)], "id long")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "paper_id long")
    assert reports.search_health(p, ids(1, 2), ids(1, 2), ids(1, 2)).first().status == "healthy"
    assert reports.search_health(p, ids(1), ids(1, 2), ids(1, 2)).first().status == "degraded"
    assert reports.search_health(p, ids(), ids(), ids()).first().status == "unhealthy"


def library(spark, rows, claims=None):
    papers = spark.createDataFrame([(r[0], "t", None) for r in rows], "id long, title string, doi string")
    c = spark.createDataFrame(rows, "paper_id long, extraction_depth string, one_sentence_summary string, deep_date string").select(
        "*", F.lit(None).cast("string").alias("deep_one_sentence_summary"), F.array().cast("array<string>").alias("key_findings"),
        F.lit(0.5).alias("verification_score"))
    j = F.lit(claims) if claims else F.lit('{"evidence": {"claims": [{"supported": true}]}}')
    c = c.withColumn("verification", F.parse_json(j))
    chunks = spark.createDataFrame([(r[0], "x") for r in rows] + [(999, "orphan")], "paper_id long, content string")
    meta = spark.createDataFrame([(r[0], "complete", 5) for r in rows], "paper_id long, chunking_status string, chunk_count int")
    ids = papers.select(F.col("id").alias("paper_id"))
    return quality.Library(papers, c, chunks, meta, ids, ids, ids)


def test_audit_repair(spark):
    lib = library(spark, [(1, "comprehensive", "", "d"), (2, "comprehensive", "fine", "d")])
    done, counts = quality.repair(lib)
    assert {r.check_key: r.repaired for r in counts.collect() if r.repaired} == {
        "empty_extraction_marked_complete": 1, "chunk_count_mismatch": 2, "orphan_chunks": 1}
    left = quality.findings({**quality.silent_failures(done), **quality.structural_failures(done)})
    assert left.filter("bad_rows > 0").count() == 0
    assert {r.paper_id: r.extraction_depth for r in done.contents.collect()} == {1: None, 2: "comprehensive"}


def test_outage_rows_are_all_cleared_but_sampled(spark):
    lib = library(spark, [(i, "comprehensive", "fine", None) for i in range(12)], '{"evidence": {"claims": [{"supported": null}]}}')
    bad = quality.outage_rows(lib.contents).select("paper_id")
    r = quality.findings({"outage": ("error", bad)}).first()
    assert r.bad_rows == 12 and r.samples == list(range(10))
    assert quality.repair(lib)[0].contents.filter("verification IS NOT NULL OR verification_score IS NOT NULL").count() == 0


def test_upsert_keeps_ids_dense_and_stable(spark):
    old = spark.createDataFrame([(3, "a"), (7, "b")], "id long, name string")
    new = spark.createDataFrame([(n,) for n in ("a", "c", "d", "c", " ", "e")], "name string")
    got = {r.name: r.id for r in changes.upsert_dim(old, new).collect()}
    assert got["a"] == 3 and got["b"] == 7 and sorted(got[n] for n in "cde") == [8, 9, 10] and len(got) == 5


def test_tiers_never_overwrite_each_other(spark):
    cols = "paper_id long, paper_type string, topics array<string>, one_sentence_summary string"
    base = spark.createDataFrame([(1, "review", ["a", "b"], "q")], cols).select(
        "*", *[F.lit(None).cast(t).alias(n) for n, t in [("deep_paper_type", "string"), ("deep_topics", "array<string>"), ("deep_one_sentence_summary", "string"),
                                                         ("key_findings", "array<string>"), ("methodology_summary", "string"), ("quick_date", "date"), ("deep_date", "date")]],
        F.lit("abstract_only").alias("extraction_depth"))
    new = spark.createDataFrame([(1, "review", ["b", "c"], "d"), (2, "letter", ["x"], "n")], cols).select(
        "*", F.lit("deep").alias("tier"), F.current_date().alias("extracted_at"), F.array(F.lit("f")).alias("key_findings"), F.lit("m").alias("methodology_summary"))
    got = {r.paper_id: r for r in changes.upsert_extractions(base, new).collect()}
    assert (got[1].one_sentence_summary, got[1].deep_one_sentence_summary, got[1].extraction_depth) == ("q", "d", "comprehensive")
    assert got[1].agreement.topics_overlap == 0.33 and got[1].agreement.paper_type_matches
    assert got[2].paper_type is None and got[2].agreement is None


def test_delete_cascades_and_unlinks(spark):
    t = {"papers": spark.createDataFrame([(1,), (2,)], "id long"), "notes": spark.createDataFrame([(1,), (2,)], "paper_id long"),
         "refs": spark.createDataFrame([(1, 2), (2, 1)], "paper_id long, matched_paper_id long")}
    out = changes.delete_papers(t, spark.createDataFrame([(1,)], "id long"), links={"refs": "matched_paper_id"})
    assert out["notes"].count() == 1 and tuple(out["refs"].first()) == (2, None)


def test_processing_status_ladder(spark):
    papers = spark.createDataFrame([(1, None), (2, "p"), (3, "p"), (4, "p")], "id long, file_path string")
    meta = spark.createDataFrame([(3, "complete", 0), (4, "complete", 2)], "paper_id long, chunking_status string, chunk_count int")
    got = {r.id: (r.status, r.needs_extraction) for r in queues.processing_status(spark.range(1, 6), papers, meta).collect()}
    assert got == {1: ("no_pdf", False), 2: ("not_extracted", True), 3: ("complete", True), 4: ("complete", False), 5: ("not_found", False)}


def test_exports_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1, 'A "q", title', ["Lee, A", "Doe, B"], 2020, "10.1/x", "J")], "id long, title string, authors array<string>, year int, doi string, journal string")
    exports.export_csv(p, str(tmp_path / "csv"))
    r = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert (r.title, r.authors) == ('A "q", title', "Lee, A; Doe, B")
    exports.export_bibliography(p, "apa", str(tmp_path / "apa"))
    assert spark.read.text(str(tmp_path / "apa")).first()[0] == 'Lee, A, Doe, B (2020). A "q", title. J. https://doi.org/10.1/x'
    exports.export_json(p, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().authors == ["Lee, A", "Doe, B"]


def test_snapshot_source(spark):
    items = spark.createDataFrame([(1, 1, "P"), (2, 9, "A"), (3, 9, "B"), (4, 1, "Q"), (5, 9, "C")], "itemID int, itemTypeID int, key string")
    att = spark.createDataFrame([(2, 1, 0, "application/pdf", "storage:x.pdf"), (3, 1, 2, "application/pdf", "storage:y.pdf"), (5, 4, 1, "application/pdf", "storage:z.pdf")],
                                "itemID int, parentItemID int, linkMode int, contentType string, path string")
    out = refmanager.attachments(items, spark.createDataFrame([(1, "journalArticle")], "itemTypeID int, typeName string"), att, spark.createDataFrame([(4,)], "itemID int"))
    assert [(r.parent_key, r.file_name) for r in out.collect()] == [("P", "x.pdf")]


def test_projects_and_library_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"projects": [{"name": "a", "topics": ["x"]}, {"name": "b", "active": false, "relevance_hints": {"high": "h"}}]}')
    assert [r.name for r in projects.read_projects(spark, str(tmp_path / "p.json")).collect()] == ["a"]
    spark.createDataFrame([(1, "n")], "id long, name string").write.parquet(str(tmp_path / "authors.parquet"))
    assert read_library(spark, str(tmp_path), ["authors"])["authors"].first().orcid is None


def test_vectors_replace_by_paper(spark, tmp_path):
    path = str(tmp_path / "v")
    row = lambda *r: spark.createDataFrame(list(r), "id string, paper_id long, embedding array<float>")
    vectorstore.write_vectors(row(("1_0", 1, [1.0]), ("1_1", 1, [2.0]), ("2_0", 2, [3.0])), path)
    vectorstore.write_vectors(row(("1_0", 1, [9.0])), path)
    got = {r.id: r.embedding for r in vectorstore.read_vectors(spark, path).collect()}
    assert got == {"1_0": [9.0], "2_0": [3.0]}


def test_index_batches_replay_safely(spark, tmp_path):
    root = str(tmp_path)
    batch = lambda *r: spark.createDataFrame(list(r), "id long, op string, version int, text string")
    first, second = batch((1, "insert", 1, "a b"), (2, "insert", 1, "b")), batch((1, "update", 2, "c"), (2, "delete", 3, None))
    index_maintenance.apply_batch(root, first, 0, {"text": 1.0})
    for _ in range(2):
        index_maintenance.apply_batch(root, second, 1, {"text": 1.0})
    assert {(r.term, r.doc_id) for r in index_maintenance.read_postings(spark, root).collect()} == {("c", 1)}
    index_maintenance.compact(spark, root, str(tmp_path / "small"))
    assert index_maintenance.read_postings(spark, str(tmp_path / "small")).count() == 1


def test_ingest_drops_known_and_repeated(spark):
    docs = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    known = spark.createDataFrame([("b",)], "text string").select(F.sha2("text", 256).alias("hash"))
    assert [r.text for r in ingest.fresh_documents(docs, known).collect()] == ["a"]


def test_status_moves():
    import pandas as pd
    rows = pd.DataFrame({"ts": [1, 2, 3, 4], "status": ["pending", "complete", "needs_pdf", "failed"]})
    status, moves = status_machine.walk(None, rows)
    assert status == "failed" and [m[3] for m in moves] == ["moved", "rejected", "moved", "moved"]


def test_registry_is_complete():
    import __spark_entry__ as entry
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
    families = {n.split("_")[0] for n in q}
    want = {f"{f}{i:02d}" for f, n in [("a", 19), ("w", 7), ("x", 7), ("r", 18), ("e", 13), ("g", 11), ("u", 7), ("p", 9), ("t", 4)] for i in range(1, n + 1)}
    covered_elsewhere = {"w02", "w05", "g07"}  # r08, c02, j05
    assert want - families <= covered_elsewhere
