"""Rules, licenses, winnowing and token counts against brute force."""

import hashlib
import re

import public_tokenizers as P
import xxhash
from conftest_llm import words

from quire.llm import licenses, rules, trie, winnow


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_rules(docs, rows, nothing):
    got = by_id(rules.decisions(docs))
    assert len(got) == len(rows) and rules.decisions(nothing).count() == 0
    for i, t, *_ in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        tri = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, g in enumerate(tri) if tri.count(g) > 1 for j in range(3)} if len(tri) < 500 else None
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        if hit is not None:
            assert r["n_repeat_words"] == len(hit)
            assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_rules_ablation(docs):
    led = rules.ledger(docs)
    assert "text" in led.columns
    masks = [r["fail_mask"] for r in led.collect()]
    policy = rules.policy_mask(rules.POLICIES["web-1"])
    for r in rules.ablations(led, "web-1").collect():
        assert r["failed"] == sum(bool(m & r["bit"]) for m in masks)
        assert r["only_this"] == sum(m & policy == r["bit"] for m in masks)
        assert r["kept"] == sum(m & policy == 0 for m in masks)


def test_rules_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_words int, Fail_Mask string")
    r = rules.ledger(df).collect()[0]
    assert r["n_words"] == 2 and r["fail_mask"] & 1


def test_licenses(docs, rows, nothing):
    got = by_id(licenses.labels(docs))
    assert len(got) == len(rows) and licenses.labels(nothing).count() == 0
    for i, t, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k:k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and 0 <= r["score"] <= 1
    labels = got[51 * 3 + 1]["labels"].split(",")
    assert labels == sorted(["apache", "apache-2.0", "cc-by-nc-4.0", "gpl", "gpl-3.0-or-later", "mit"])


def test_license_containment(spark):
    df = spark.createDataFrame([(1, "SPDX-License-Identifier: LGPL-2.1-or-later"), (2, "the GNU General Public License v2"), (3, "spdx license identifier: mit. mit license mit license"), (4, "CC\nBY")], "doc_id long, text string")
    d = licenses.scan(df).filter("rule IS NOT NULL").collect()
    assert {(r["doc_id"], r["label"], r["start"], r["end"]) for r in d} == {
        (1, "lgpl-2.1-or-later", 0, 8), (2, "gpl-2.0", 1, 6), (3, "mit", 0, 4), (3, "mit", 4, 6), (3, "mit", 6, 8), (4, "cc-by", 0, 2)}


def _marks(t):
    def run(ws):
        h = 42
        for x in ws:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        h >>= 24
        return h - (1 << 40) if h >> 39 else h

    w, k, n = words(t), winnow.K, winnow.WINDOW
    runs = [(run(w[i:i + k]), -i) for i in range(len(w) - k + 1)] or ([(run([" ".join(w)]), 0)] if w else [])
    out = []
    for j in range(max(1, len(runs) - n + 1) if runs else 0):
        m = min(runs[j:j + n])
        if m not in out[-1:]:
            out.append(m)
    return out


def test_winnowing(docs, rows, nothing):
    got = by_id(winnow.edited(docs))
    assert len(got) == len(rows) and winnow.edited(nothing).count() == 0
    text = {i: t or "" for i, t, *_ in rows}
    ids = sorted(text, reverse=True)
    show = lambda m: ",".join(f"{h & (1 << 40) - 1:010x}@{-i}" for h, i in m)
    like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    sets = {i: {h for h, _ in _marks(t)} for i, t in text.items()}
    for k, i in enumerate(ids):
        after, t = ids[(k + 1) % len(ids)], text[i]
        new = t[:len(t) - len(t) // 3] + text[after][:len(t) // 3]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (show(_marks(t)), show(_marks(new)))
        assert abs(r["near_edited"] - like(sets[i], {h for h, _ in _marks(new)})) < 1e-12 and abs(r["near_next"] - like(sets[i], sets[after])) < 1e-12


def test_winnowing_guarantee_and_repeats(spark):
    shared = " ".join(f"s{k}" for k in range(winnow.K + winnow.WINDOW - 1))
    df = spark.createDataFrame([(1, f"a b c {shared} d e"), (2, f"{shared} q"), (2, f"{shared} q"), (None, "z " * 9)], "doc_id long, text string")
    fp = [set(re.findall(r"(\w+)@", r["fingerprint"])) for r in winnow.fingerprints(df).orderBy("doc_id").collect()]
    assert fp[1] & fp[2] and fp[2] == fp[3]
    assert winnow.edited(df).count() == 4


def test_token_counts(docs, rows, nothing):
    path = P.path("piece_bpe_32k.model")
    vocabulary, byte = trie.read_vocabulary(path)

    def best(word):
        word, at = trie.MARK + word, [(0.0, 0)]
        for j in range(len(word)):
            n = len(word[j].encode())
            options = [(at[j][0] + n * byte, at[j][1] - n)]
            options += [(at[i][0] + vocabulary[word[i:j + 1]], at[i][1] - 1) for i in range(j + 1) if word[i:j + 1] in vocabulary]
            at.append(max(options))
        return at[-1]

    got = by_id(trie.token_counts(docs, path, drop=("text",)))
    assert trie.counts(nothing, path).count() == 0
    for i, t, *_ in rows:
        each = [best(w) for w in words(t)]
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(each), -sum(n for _, n in each))
        assert abs(got[i]["score"] - sum(s for s, _ in each)) < 1e-6 * max(1, -got[i]["score"])


def test_trie_shares_prefixes():
    walk = trie.Walk({"a": -1.0, "ab": -1.5, "abc": -1.0}, -9.0)
    assert walk.to("abc") == (1, -1.0) and walk.nodes == 3
    assert walk.to("abcab") == (2, -2.5) and walk.nodes == 5
    assert walk.to("abd") == (2, -10.5) and walk.nodes == 6
