"""Byte-level BPE, classifier and WARC records."""

import base64
import hashlib
import random
from array import array

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from quire.llm import bpe, quality, warc

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def library():
    with open(PATH, "rb") as f:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


def test_bpe(docs, rows, nothing):
    enc, got = library(), by_id(bpe.digests(docs, PATH, P.PATTERN))
    apart = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).collect()
    assert {bytes(r["decoded"]) for r in apart} == {(t or "").encode() for _, t, *_ in rows}
    assert len(got) == len(rows) and bpe.digests(nothing, PATH, P.PATTERN).count() == 0
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want


def test_bpe_odd_characters(spark):
    r, enc = random.Random(5), library()
    pools = [(32, 126), (0x80, 0x7FF), (0x800, 0xD7FF), (0x10000, 0x1FFFF), (9, 13), (0xE000, 0xFFFF)]
    texts = ["".join(chr(r.randint(*r.choice(pools))) for _ in range(r.randrange(1, 60))) for _ in range(800)]
    texts += ["a" * 3000, " " * 500, "\n\n \n", "it's we'll I'D", "\x00\x01", "🤷🏽‍♀️" * 20, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(bpe.encode(df, PATH, P.PATTERN))
    assert all(list(array("I", got[i]["ids"])) == enc.encode_ordinary(t) for i, t in enumerate(texts))


def test_bpe_offsets_and_split_characters(spark):
    text = "naïve 日本 🤷 ok"
    df = spark.createDataFrame([(1, text, 9, b"x")], "doc_id long, text string, n_tokens int, IDS binary")
    r = bpe.encode(df, PATH, P.PATTERN, offsets=True).collect()[0]
    assert set(r.asDict()) == {"doc_id", "text", "n_tokens", "ids", "starts", "ends"}
    raw = [library().decode_single_token_bytes(i) for i in array("I", r["ids"])]
    at = 0
    for token, a, b in zip(raw, r["starts"], r["ends"]):
        chars = [k for k in range(len(text)) if len(text[:k + 1].encode()) > at and len(text[:k].encode()) < at + len(token)]
        assert (a, b) == (chars[0], chars[-1] + 1)
        at += len(token)
    cut = spark.createDataFrame([(1, bytes(r["ids"][:4 * k])) for k in range(r["n_tokens"] + 1)] + [(2, None)], "doc_id long, ids binary")
    done = [x["decoded"] for x in bpe.decode(cut, PATH, as_text=True).collect()]
    assert done[-2] == text and done[-1] == "" and any("�" in x for x in done)


def test_quality(spark, nothing):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioudtnrs") for _ in range(r.randrange(2, 9)))
    good = lambda: " ".join(word() for _ in range(60)).capitalize() + "."
    bad = lambda: r.choice([lambda: " ".join(word() + "***" for _ in range(60)), lambda: " ".join(word().upper() + "!!" for _ in range(60)), lambda: " ".join([word()] * 60)])()
    data = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(9001, None), (9002, ""), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y if i % 50 else None) for i, _, y in data] + [(None, 1)], "doc_id long, quality int")
    got = quality.scored(docs, labels)
    assert got.count() == 903
    r = {x["doc_id"]: x for x in got.collect()}
    held = [(i, y) for i, _, y in data if r[i]["held_out"]]
    assert 200 < len(held) < 400 and sum(r[i]["predicted"] == y for i, y in held) >= 0.98 * len(held)
    assert r[9001]["score"] == r[9002]["score"] and all(0 <= x["score"] <= 1 for x in r.values())
    assert quality.scored(nothing, labels).count() == 0
    none = quality.scored(docs, labels.limit(0)).collect()
    assert {x["score"] for x in none} == {0.5}


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 30) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.scored(docs, labels).orderBy("doc_id").collect() == quality.scored(docs, other).orderBy("doc_id").collect()


def test_warc(spark, tmp_path):
    html = "<title>A &amp; B</title><style>x</style><p>Hi&nbsp;there &#9731;</p><!-- c --><a href='/x'>l</a><a href=\"y?z\">m</a><a href='#t'>n</a><script>var a='</p>'</script>"
    pages = spark.createDataFrame([(1, "http://e.org/d/i.html", html, "k"), (2, None, None, "k"), (2, None, None, "k"), (3, "http://e.org", "", None)], "page_id long, url string, html string, record_id string")
    out = warc.derivatives(pages).cache()
    assert out.count() == 8 and warc.derivatives(pages.limit(0)).count() == 0
    own = {r["record_type"]: r for r in out.filter("page_id = 1").collect()}
    conv, meta = own["conversion"], own["metadata"]
    assert conv["block"] == "A & B\nHi there ☃\nlmn"
    want = "sha1:" + base64.b32encode(hashlib.sha1(conv["block"].encode()).digest()).decode()
    assert conv["block_digest"] == want and f"WARC-Block-Digest: {want}\r\n" in conv["header"]
    assert conv["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert conv["refers_to"] == meta["refers_to"] and f"WARC-Refers-To: {conv['refers_to']}\r\n" in conv["header"] and conv["record_id"] != meta["record_id"]
    assert "outlink: http://e.org/x\r\noutlink: http://e.org/d/y?z\r\n" in meta["block"] and "source-header: Content-Type: text/html" in meta["block"] and "title: A & B\r\n" in meta["block"]
    raw = "<p>a</p><a href=/q?a=1&amp;b=2>x</a><a href=\"it's\">y</a><a class=k href=z>w</a><!-- open <a href=/c>c</a><script>var x=1;"
    odd = {r["record_type"]: r for r in warc.derivatives(spark.createDataFrame([(1, "http://e.org/d/", raw)], "page_id long, url string, html string")).collect()}
    assert odd["conversion"]["block"] == "a\nxyw" and odd["metadata"]["n_links"] == 4
    assert "outlink: http://e.org/q?a=1&b=2\r\noutlink: http://e.org/d/it's\r\noutlink: http://e.org/d/z\r\noutlink: http://e.org/c\r\n" in odd["metadata"]["block"]
    path = str(tmp_path / "w")
    warc.write(out, path)
    back = {(r["record_id"], r["record_type"], r["refers_to"], r["block"]) for r in warc.read(spark, path).collect()}
    assert back == {(r["record_id"], r["record_type"], r["refers_to"], r["block"]) for r in out.collect()}
