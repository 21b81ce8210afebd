from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.functions import similarity as sim, text as fx
from quire.functions.stemming import porter


@pytest.mark.parametrize("authors,title,year,key", [
    ("Smith, John", "Machine Learning", 2023, "smith2023machine"),
    ("John Smith", "The Art of Programming", 2020, "smith2020art"),
    ("Doe, Jane", "A Study of AI", None, "doestudy"),
    ("Smith, J. and Doe, J.", "On the Origin", 1859, "smith1859origin"),
    (None, "Deep Learning", 2015, "unknown2015deep"),
    ("O'Brien, Pat", "An Essay", 2001, "obrien2001essay"),
])
def test_citation_key(spark, authors, title, year, key):
    df = spark.createDataFrame([(authors, title, year)], "a string, t string, y int")
    assert df.select(fx.citation_key("t", "a", "y")).first()[0] == key


@pytest.mark.parametrize("raw,want", [
    ("https://doi.org/10.1/AAA", "10.1/aaa"), ("doi:10.1/bbb", "10.1/bbb"), ("http://dx.doi.org/10.1/c ", "10.1/c"),
    ("  10.1/D", "10.1/d"), ("", None), (None, None)])
def test_doi_key(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "d string").select(fx.doi_key("d")).first()[0] == want


def test_numbers_are_canonical(one):
    assert one(fx.numbers("t"), t="1,250 and 1.25e3 and 99.9") == [1250.0, 1250.0, 99.9]


def test_quote_form(one):
    assert one(fx.quote_form("t"), t=" “Metal-Organic”\n Films’ ") == "metalorganic films"


@pytest.mark.parametrize("text,n", [
    ('```json\n{"paper_type": "review", "topics": ["a",], "one_sentence_summary": "s",}\n```', 0),
    ('noise {"paper_type": null, "topics": []} tail', 2)])
def test_response_parsing(one, text, n):
    assert len(one(fx.missing_fields(fx.response_object("t"), "quick"), t=text)) == n


def test_response_without_object(one):
    assert one(fx.response_object("t"), t="no object here") is None


def test_porter_published_examples():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
             "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat",
             "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adjustment": "adjust",
             "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "corrosion": "corros"}
    assert {w: porter(w) for w in pairs} == pairs


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a and b else 0.0


def test_pair_measures_match_plain_python(spark):
    pairs = [("atomic layer", "atomic layers"), ("abc", ""), ("growth per cycle", "cycle growth"), ("éclair", "eclair"), ("aab", "abb")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sim.lcs_dice("a", "b").alias("l"), sim.block_ratio("a", "b").alias("r")).collect()
    for r in rows:
        assert r.l == pytest.approx(brute_lcs(r.a, r.b))
        assert r.r == pytest.approx(SequenceMatcher(None, r.a, r.b).ratio())


def test_title_similarity(spark):
    cases = [("ALD of alumina", "Atomic layer deposition of alumina"), ("Neural networks", "Soil bacteria in winter"),
             ("Corrosion of steel", "Corosion of steel"), ("", "x")]
    got = [r[0] for r in spark.createDataFrame(cases, "a string, b string").select(sim.title_similarity("a", "b")).collect()]
    assert got[0] == pytest.approx(1.0)
    assert got[1] < 0.2
    assert got[2] == pytest.approx(0.6 + 0.3 * 3 / 4)  # both content words covered, three matches in a union of four
    assert got[3] == 0.0


def test_scores(one):
    assert one(sim.year_score(F.lit(2020), F.lit(2021))) == 0.7
    assert one(sim.author_score(F.lit("J. Smith"), F.array(F.lit("Smith, John")))) == 1.0
    assert one(sim.author_score(F.lit(None).cast("string"), F.array(F.lit("x")))) == 0.5
    assert one(sim.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_bounded_edits_agree_with_unbounded(spark):
    rows = [("kitten" * n, "sitting" * n) for n in (1, 3, 9)] + [("abcdefghij", "abcdefghix"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string").select(
        sim.edit_similarity(F.col("a"), F.col("b")).alias("full"), sim.bounded_edit_similarity(F.col("a"), F.col("b"), 0.85).alias("part"))
    for r in df.collect():
        assert (r.part == pytest.approx(r.full)) if r.full >= 0.85 else (r.part is None or r.part < 0.85)
