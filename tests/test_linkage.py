import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.functions import similarity
from quire.operators import graph, linkage, merging
from quire.operators.enrich import length_window_join


def texts(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 40))).strip() or "x" for _ in range(n)]
    out = set(base)
    for s in base:
        t = list(s)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(t) + 1)
            t[i:i] = rng.choice("abc")
            if rng.random() < .5 and len(t) > 1:
                del t[rng.randrange(len(t))]
        out.add("".join(t).strip() or "y")
    return sorted(out)


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("measure,t", [("ratio", 0.92), ("ratio", 0.85), ("ratio", 0.7), ("ratio", 0.6), ("edits", 0.85), ("edits", 0.6)])
@pytest.mark.parametrize("seed", [11, 12])
def test_blocking_loses_no_pair(spark, measure, t, seed):
    words = texts(60, seed)
    df = spark.createDataFrame(list(enumerate(words)), "key long, text string")
    got = {(r.key_a, r.key_b) for r in linkage.similar_texts(df, None, t, measure=measure).collect()}
    score = (lambda a, b: SequenceMatcher(None, a, b).ratio()) if measure == "ratio" else (lambda a, b: 1 - lev(a, b) / max(len(a), len(b)))
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if score(words[i], words[j]) >= t}
    assert want and got == want


def test_length_window_never_excludes_a_duplicate(spark):
    words = texts(40, 4)
    df = spark.createDataFrame(list(enumerate(words)), "id long, title string")
    kept = {(r.a_id, r.b_id) for r in length_window_join(df, df, 0.92).collect()}
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if SequenceMatcher(None, a, b).ratio() >= 0.92:
                assert (i, j) in kept


def test_find_existing_cascade(spark):
    lib = spark.createDataFrame([(1, "10.1/A", None, "Growth of thin films by pulses", 1), (2, None, "2401.1", "Other work entirely", 2),
                                 (3, None, None, "Study of surface corrosion in alloys", 3), (4, None, None, "Study of surface corrosion in alloys.", 4)],
                                "id long, doi string, arxiv_id string, title string, date_added int")
    new = spark.createDataFrame([(10, "https://doi.org/10.1/a", None, "x"), (11, None, "2401.1", "y"), (12, None, None, "STUDY OF SURFACE CORROSION IN ALLOYS"),
                                 (13, None, None, "Unrelated title about soil")], "record_id long, doi string, arxiv_id string, title string")
    got = {r.record_id: (r.match_type, r.existing_id) for r in linkage.find_existing(new, lib).collect()}
    assert got == {10: ("doi", 1), 11: ("arxiv_id", 2), 12: ("title_similarity", 4)}


def sequential(rows, owners, known):
    seen, handled, out = set(known), set(), {}
    for n, parent, h in rows:
        pid, has = owners.get(parent, (None, False))
        if parent in handled:
            out[n] = "skip_extra_pdf"
        elif has:
            handled.add(parent)
            out[n] = "skip_has_pdf"
        elif h is None:
            out[n] = "skip_missing_file"
        elif h in seen:
            out[n] = "skip_duplicate_hash"
        else:
            seen.add(h)
            handled.add(parent)
            out[n] = "attach" if pid is not None else "new_import"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_plan_import_equals_sequential(spark, seed):
    rng = random.Random(seed)
    rows = [(n, f"p{rng.randrange(40)}", rng.choice([None] + [f"h{i}" for i in range(30)])) for n in range(200)]
    owners = {f"p{i}": (i, i % 5 == 0) for i in range(0, 40, 2)}
    papers = spark.createDataFrame([(k, v[0], "/x.pdf" if v[1] else None) for k, v in owners.items()], "zotero_key string, id long, file_path string")
    att = spark.createDataFrame(rows, "ordinal long, parent_key string, file_hash string")
    got = {r.ordinal: r.action for r in linkage.plan_import(att, papers, spark.createDataFrame([("h1",)], "file_hash string")).collect()}
    assert got == sequential(rows, owners, {"h1"})


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(100, 101)], [(5, 3), (3, 9), (9, 1), (20, 21), (22, 21)]])
def test_clusters(spark, pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.cluster_id for r in graph.clusters(spark.createDataFrame(pairs, "id_a long, id_b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_common_references_normalise_and_survive_a_hub(spark):
    rows = [(1, "10.1/aaa"), (1, "10.1/bbb"), (1, "10.1/ccc"), (2, "10.1/AAA"), (2, "doi:10.1/bbb"), (3, "10.1/aaa"), (4, "https://doi.org/10.1/aaa"), (4, "10.1/BBB")]
    rows += [(100 + i, "10.9/hub") for i in range(50)] + [(1, "10.9/hub")]
    got = {(r.paper_a, r.paper_b): r.shared_references for r in graph.common_references(spark.createDataFrame(rows, "paper_id long, parsed_doi string"), 2).collect()}
    assert got == {(1, 2): 2, (1, 4): 2, (2, 4): 2}


def _shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("listed", [64, 3])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_common_references_equal_all_pairs(spark, monkeypatch, listed, least):
    monkeypatch.setattr(graph, "LISTED", listed)
    rng = random.Random(8)
    works = {p: sorted({f"10.1/{int(rng.expovariate(0.1))}" for _ in range(rng.randint(1, 6))}) for p in range(60)}
    df = spark.createDataFrame([(p, w) for p, ws in works.items() for w in ws] + [(None, "10.1/0"), (None, "10.1/1"), (5, None)], "paper_id long, parsed_doi string")
    want = {(a, b): s for a in works for b in works if a < b and len(s := sorted(set(works[a]) & set(works[b]))) >= least}
    got = {(r.paper_a, r.paper_b): (r.shared_references, r.shared_dois) for r in graph.common_references(df, least).collect()}
    assert got == {k: (len(s), s[:5]) for k, s in want.items()}


def test_common_references_do_not_shuffle_the_pairs_of_a_work(spark):
    # 400 works of 30 papers each make 174,000 pairs of papers, of which few share two
    rng = random.Random(9)
    df = spark.createDataFrame([(p, f"10.1/{w}") for p in range(4000) for w in rng.sample(range(400), 3)], "paper_id long, parsed_doi string")
    before = _shuffled(spark)
    assert 0 < graph.common_references(df, 2).count() < 2000
    assert _shuffled(spark) - before < 800_000


def test_chain_levels_and_direction(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "citing long, cited long")
    seeds = spark.createDataFrame([(1,)], "id long")
    level = lambda df: {(r.level, r.paper_id) for r in df.collect()}
    assert level(graph.chain(edges, seeds, depth=3)) == {(1, 2), (1, 3), (2, 4), (3, 1)}
    assert level(graph.chain(edges, seeds, depth=3, visited=True)) == {(1, 2), (1, 3), (2, 4)}
    assert level(graph.chain(edges, seeds, depth=1, direction="backward")) == {(1, 4)}


def test_link_claims_statuses(spark):
    refs = spark.createDataFrame([(1, 0, 70, 900), (1, 1, 71, None)], "paper_id long, reference_order int, reference_id long, matched_paper_id long")
    c = spark.createDataFrame([(5, 1, [1, 2, 3, 0])], "claim_id long, paper_id long, citation_numbers array<int>")
    r = graph.link_claims(c, refs).first()
    assert r.match_statuses == ["matched", "unmatched", "reference_not_found", "reference_not_found"]
    assert r.matched_paper_ids == [900, None, None, None]


def test_merge_sources(spark):
    rows = [("r", "b", 0.8, 2, "T2", None, 2999, ["A" * 250]), ("r", "a", 0.9, 1, "T1", "", None, []), ("r", "c", 0.8, 3, "T3", "abs", 2020, ["Z"])]
    m = merging.merge_sources(spark.createDataFrame(rows, "record_id string, source string, confidence double, ordinal int, title string, abstract string, year int, authors array<string>")).first()
    assert (m.title, m.abstract, m.year, m.authors) == ("T1", "abs", None, ["A" * 200])
    assert m.sources_used == ["a", "b", "c"] and m.primary_source == "a"
    assert m.missing_fields == ["year"] and set(m.warnings) == {"suspicious_year", "author_truncated"}


def test_best_match_policies(spark):
    rec = spark.createDataFrame([(1, "Atomic layer deposition of alumina", "Smith", 2020)], "record_id long, title string, author string, year int")
    cand = spark.createDataFrame([(1, 7, "Atomic layer deposition of alumina", ["J. Smith"], 2020), (1, 8, "Atomic layer etching of silica", ["X"], 2001)],
                                 "record_id long, candidate_id long, title string, authors array<string>, year int")
    for policy in ("search", "strict", "validate"):
        r = merging.best_match(rec, cand, policy).first()
        assert (r.candidate_id, r.score) == (7, 1.0)


@pytest.mark.parametrize("measure", ["ratio", "edits"])
def test_common_grams_make_few_candidates(spark, measure):
    # every text holds the same frequent words among others, and one is a single word over and over
    rng = random.Random(5)
    other = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))
    base = [" ".join(w for _ in range(6) for w in (rng.choice(["then", "the", "tion"]), other())) for _ in range(300)]
    words = sorted({*base, *(t + "x" for t in base[:20]), "rend " * 2000})
    df = spark.createDataFrame(list(enumerate(words)), "key long, text string")
    pairs = linkage._candidates(df, df, 0.9, measure, F.col("key_a") < F.col("key_b")).distinct()
    found = {tuple(sorted((words[r.key_a], words[r.key_b]))) for r in pairs.collect()}
    assert {(t, t + "x") for t in base[:20]} <= found
    assert len(found) < 0.1 * len(words) * (len(words) - 1) / 2


def test_best_match_without_a_title_is_none(spark):
    rec = spark.createDataFrame([(1, None, "Smith", 2020), (2, "Alumina", "Smith", 2020)], "record_id long, title string, author string, year int")
    cand = spark.createDataFrame([(1, 7, "Alumina", ["J. Smith"], 2020), (2, 8, None, ["J. Smith"], 2020)], "record_id long, candidate_id long, title string, authors array<string>, year int")
    assert merging.best_match(rec, cand).count() == 0  # least() skipped the missing similarity


def test_best_match_in_groups_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(8)
    words = ["the", "tion", "jk", "qx", "and", "ab", "1", "éa", "😀"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 4, 6, 9, 20, 45, 90])))
    some = [title() for _ in range(25)]
    pick = lambda: rng.choice([None, rng.choice(some), *(title() + rng.choice(["", " xyz", "12 pq"]) for _ in range(8))])
    rec = [(i, rng.choice(["g", "h", "only records", None]), pick(), rng.choice(["Li", "Smith", "", None]), rng.choice([2000, 2001, None])) for i in range(150)]
    cand = [(f"c{i}", rng.choice(["g", "h", "only candidates"]), pick(), rng.choice([["J. Smith", "Li"], ["Lin", None], [], None]), rng.choice([2000, 2001, None])) for i in range(150)]
    r = spark.createDataFrame(rec, "record_id long, g string, title string, author string, year int")
    c = spark.createDataFrame(cand, "candidate_id string, g string, title string, authors array<string>, year int")
    want = merging.best_match(r, r.select("record_id", "g").join(c, "g").drop("g"), "search")
    want = sorted(map(tuple, want.collect()))
    assert len(want) > 50 and len({x[2] for x in want}) > 12
    assert sorted(map(tuple, merging.best_match_in_groups(r, c, ["g"]).collect())) == want
    monkeypatch.setattr(merging, "OFFERED", 20)
    monkeypatch.setattr(merging, "FEWEST", 8)
    assert sorted(map(tuple, merging.best_match_in_groups(r, c, ["g"]).collect())) == want
    assert merging.best_match_in_groups(r.filter("g = 'only records'"), c, ["g"]).count() == 0


def test_matching_size_is_that_of_sequence_matcher():
    from difflib import SequenceMatcher

    from quire.functions.similarity import CommonLengths, matching_size, places
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(["the", "tion", "xq", "z", "and ", "é", "jk "]) for _ in range(rng.choice([0, 1, 3, 10, 30, 80, 200])))
    texts = sorted((text() for _ in range(40)), key=len)
    short = [t for t in texts if len(t) < 200]
    common = CommonLengths(short)
    for _ in range(150):
        a = text()
        bound = common.to(a, 0, len(short))
        for k, b in enumerate(texts):
            m = sum(x.size for x in SequenceMatcher(None, a, b).get_matching_blocks())
            assert matching_size(a, b, places(b)) == matching_size(a, b, places(b), m) == m and matching_size(a, b, places(b), m + 1) == -1
            assert k >= len(short) or m <= bound[k] <= min(len(a), len(b))


@pytest.mark.parametrize("t,measure", [(0.85, "edits"), (0.9, "ratio")])
def test_titles_of_the_same_syllables_are_seldom_candidates(spark, t, measure):
    """What stands before and after a shared gram decides where the grams meet."""
    r = random.Random(8)
    parts = ["th", "an", "er", "on", "ed", "st", "ou", "the", "ing", "and ", "of ", "to ", "wh", "ble "]
    text = ["".join(r.choice(parts) for _ in range(r.randint(14, 30))).strip() for _ in range(1200)]
    text += [x[:9] + x[10:] for x in text[:40]]
    df = spark.createDataFrame(sorted({x: i for i, x in enumerate(text)}.items()), "text string, key long")
    pairs = {(x[0], x[1]) for x in linkage._candidates(df, df, t, measure, F.col("key_a") < F.col("key_b")).collect()}
    assert {(i, i + 1200) for i in range(40)} <= {tuple(sorted(p)) for p in pairs}
    assert len(pairs) < 500


def test_distances_of_long_texts_in_numbers(spark):
    r = random.Random(9)
    rows = [("ab", "b", 1), ("a", "b", 1), ("é" * 70, "é" * 69 + "x", 1), ("kitten", "sitting", 3)]
    for n in (63, 64, 65, 300, 2000):
        x = "".join(r.choice("abcde ") for _ in range(n))
        rows.append((x, x[:n // 3] + "Z" + x[n // 3 + 4:], 4))
    df = spark.createDataFrame(rows, "a string, b string, n int")
    got = df.select("n", similarity.edits_within("a", "b", F.col("n")), similarity.edits_within("b", "a", F.col("n") - 1), F.levenshtein("a", "b")).collect()
    assert all(n == within == built_in and beyond is None for n, within, beyond, built_in in got)
