"""Spelling variants, importance resampling and the toxicity classifier against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import resample, spelling, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def grouped(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [o for o in n if edits_one(w, o)] for w in n}
    form = {w: (lambda b: b if b and n[b] >= 10 * n[w] else None)(min(near[w], key=lambda o: (-n[o], o), default=None)) for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_spelling(spark, docs, rows, nothing):
    r = random.Random(4)
    bases = ["".join(r.choice("abcdeéß") for _ in range(r.randint(7, 12))) for _ in range(25)] + ["aaaaaaaaa", "abababab", "÷×ÀÿÀÿÀ"]

    def typo(w):
        i, c = r.randrange(len(w)), r.choice("abé")
        return r.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:i + 2] + w[i:i + 1] + w[i + 2:]])

    made = [(k, " ".join(r.choice(bases).upper() if r.random() < 0.1 else r.choice(bases) for _ in range(120)) + " " + " ".join(typo(r.choice(bases)) for _ in range(25))) for k in range(60)]
    made += [(100, None), (101, ""), (102, "1234 _ -"), (103, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + " " + "x" * 4999), (104, typo(typo(bases[0])) * 2)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    got = {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling.grouped(df).collect()}
    want = grouped(made)
    assert got == want and sum(f is not None for f, *_ in want.values()) > 20
    assert {x["word"]: x["n"] for x in spelling.grouped(docs).collect()} == {w: v[2] for w, v in grouped([(i, t) for i, t, *_ in rows]).items()}
    assert spelling.grouped(nothing).count() == 0
    assert "CartesianProduct" not in spelling.near(spelling.counted(df))._jdf.queryExecution().executedPlan().toString()


def test_chains_of_forms_and_repeated_rows(spark):
    n = [("abcdefghij", 2000), ("abcdefghi", 200), ("abcdefgh", 20), ("abcdefg", 2), ("zbcdefgh", 20)]
    df = spark.createDataFrame([(k, " ".join([w] * c)) for k, (w, c) in enumerate(n)] * 1, "doc_id long, text string")
    got = {x["word"]: x for x in spelling.variants(df).collect()}
    assert [got[w]["root"] for w, _ in n] == ["abcdefghij"] * 4 + ["zbcdefgh"]
    assert got["abcdefg"]["form"] == "abcdefgh" and got["abcdefgh"]["n_near"] == 3 and got["zbcdefgh"]["form"] is None
    twice = {x["word"]: x["n"] for x in spelling.variants(df.unionAll(df)).collect()}
    assert twice == {w: 2 * c for w, c in n}
    with pytest.raises(ValueError):
        spelling.near(spelling.counted(df), least_chars=3)


def test_pivots_are_disjoint_and_cheapest():
    from itertools import combinations

    r = random.Random(1)
    for _ in range(300):
        places = sorted(r.sample(range(9), r.randint(3, 6)))
        costs = [r.randint(1, 9) for _ in places]
        got = spelling.pivots_of(places, costs, 2)
        best = min(costs[a] + costs[b] for a, b in combinations(range(len(places)), 2) if places[b] - places[a] >= 2)
        assert len(got) == 2 and places[got[1]] - places[got[0]] >= 2 and sum(costs[k] for k in got) == best


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(t, n):
    w = WORD.findall((t or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("n,buckets", [(1, 10000), (3, 64)])
def test_resampling(spark, docs, rows, nothing, n, buckets):
    target = [(0, "Alpha beta gamma"), (1, None), (2, ""), (3, "naïve of the the")]
    t = spark.createDataFrame(target, "item_id long, text string")
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda texts: Counter(bucket(f) for x in texts for f in features(x, n)[1])
    s, g = count([r[1] for r in rows]), count([x for _, x in target])
    S, T = sum(s.values()), sum(g.values())
    gain = lambda b: math.floor(1000 * math.log((g[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    want = {}
    for i, text, *_ in rows:
        words, f = features(text, n)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        want[i] = [words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    drawn = sorted((-v[3], i) for i, v in want.items() if v[0] >= 20)
    rank = {i: k + 1 for k, (_, i) in enumerate(drawn[:len(drawn) * 30 // 100])}
    gains = resample.gains(docs, t, n=n, buckets=buckets)
    out = resample.draw(resample.weigh(docs, gains, n=n), percent=30)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [*docs.columns, "n_words", "n_features", "weight", "score", "rank"] and rank
    assert {i: [r["n_words"], r["n_features"], r["weight"], r["score"]] for i, r in got.items()} == want
    assert {i: r["rank"] for i, r in got.items() if r["rank"]} == rank
    assert resample.resampled(nothing, t).count() == 0 and resample.resampled(docs, nothing).count() == len(rows)


def test_resampling_ties_nulls_and_clashing_names(spark):
    text = "word " * 30
    rows = [(k, text, "x", 7, 1.0) for k in range(500)] + [(None, text, "x", 7, 1.0)] * 3 + [(5, text, "x", 7, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, rank int, weight double").repartition(3)
    out = resample.draw(resample.weigh(docs, resample.gains(docs, docs)), percent=50).collect()
    ranked = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 253))
    key = lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0)
    assert [key(r) for r in ranked] == sorted(key(r) for r in ranked)


def plain_ftrl(rows, start, epochs, alpha, beta, l1, l2):
    """FTRL-proximal on dictionaries, one coordinate after the other."""
    z, n, bias, seen = Counter(), Counter(), start, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(epochs):
        for y, at in rows:
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35, min(35, bias + sum(w.values()))))) - y
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
            seen += g * g
            bias -= alpha / (beta + math.sqrt(seen)) * g
    return {i: weight(i) for i in z if weight(i)}, bias


def test_ftrl_steps_against_a_plain_twin():
    r = np.random.default_rng(2)
    rows = [(int(r.random() < 0.4), np.unique(r.integers(0, 60, r.integers(0, 12)))) for _ in range(200)]
    how = dict(start=-0.5, epochs=3, alpha=0.7, beta=1.0, l1=1.5, l2=0.3)
    w, bias = toxicity.ftrl(rows, **how)
    want, b = plain_ftrl([(y, at.tolist()) for y, at in rows], **how)
    assert set(w) == set(want) and all(abs(w[i] - want[i]) < 1e-9 for i in w) and abs(bias - b) < 1e-9 and 0 < len(w) < 60


def test_toxicity_features_and_held_out(spark, nothing):
    doc, index = toxicity.features(pa.array(["a b c d", None, "A b!", "", "a b c d"]))
    pairs = {1: 3, 2: 2, 3: 1}
    assert np.bincount(doc, minlength=5).tolist() == [4 + sum(pairs.values()), 0, 3, 0, 10]
    assert index[doc == 0].tolist() == index[doc == 4].tolist() and set(index[doc == 2]) <= set(index[doc == 0])
    r = random.Random(7)
    vocab = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(900):
        bad = r.random() < 0.3
        w = [r.choice(vocab) for _ in range(r.choice([3, 30, 300]))]
        if bad:
            w[r.randrange(len(w))] = r.choice(["scum", "idiot"])
        rows.append((k, " ".join(w), 1.5))
        labels += [(k, int(bad)), (k, int(bad))]
    rows += [(2000, None, 0.0), (2001, "", 0.0), (None, "you scum", 0.0)]
    labels += [(3000, 1), (5, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.scored(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got)
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got)
    truth = {i: y for i, y in labels if i is not None and y is not None}
    held = [(x["predicted"], truth[x["doc_id"]]) for x in got if x["held_out"] and x["doc_id"] in truth]
    assert np.mean([p == y for p, y in held]) > 0.97
    flipped = lab.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {x["doc_id"]: x["score"] for x in toxicity.scored(docs, flipped).collect()}
    assert all(again[x["doc_id"]] == x["score"] for x in got)  # held-out labels change nothing
    assert toxicity.scored(nothing, lab).count() == 0
    assert {x["score"] for x in toxicity.scored(docs, lab.limit(0)).collect()} == {0.5}
