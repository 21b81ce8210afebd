"""Mixing, repeated passages, near-duplicates and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import xxhash
from conftest_llm import SCHEMA, sample, words

from quire.llm import mixing, quality, recompression, simhash, similar


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def cut(rows, size=recompression.SIZE):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w, gone = words(t), set()
        for s in range(len(w) - size + 1):
            g = tuple(w[s:s + size])
            if g in seen:
                gone.update(range(s, s + size))
            seen.add(g)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_repeats(docs, rows, nothing):
    want, got = cut([(i, t) for i, t, *_ in rows]), by_id(recompression.digests(docs))
    assert recompression.digests(nothing).count() == 0 and set(got) == set(want) and any(n for _, n, _ in want.values())
    for i, (n, gone, text) in want.items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, hashlib.sha256(text.encode()).hexdigest())


def test_repeats_hard_windows(spark):
    """Few words, so that runs, periods and overlaps abound; many small pieces of one passage."""
    r = random.Random(11)
    base = [r.choice("ab") for _ in range(60)]
    texts = [" ".join(base[a:a + r.randrange(18, 40)]) for a in (r.randrange(40) for _ in range(60))]
    texts += [" ".join(["a"] * n) for n in (19, 20, 21, 50, 90)] + [" ".join(["a", "b"] * n) for n in (9, 10, 11, 30)] + [" ".join(["a", "b", "c"] * 15 + ["a"] * 25)] * 3
    texts += [" ".join(r.choice("abc") for _ in range(r.randrange(15, 200))) for _ in range(40)]
    rows = [(k * 2, t) for k, t in enumerate(r.sample(texts, len(texts)))]
    want, got = cut(rows), by_id(recompression.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)))
    assert all((got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == x for i, x in want.items())


def test_repeats_rows_without_or_with_equal_ids(spark):
    a, b = " ".join(f"w{k}" for k in range(30)), " ".join(f"w{k}" for k in range(5, 40))
    df = spark.createDataFrame([(1, a, 7), (1, a, 7), (2, b, 8), (None, a, 9)], "doc_id long, text string, n_words int")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in recompression.remove_repeats(df).collect())
    assert got == [(0, 30, 30), (1, 30, 0), (1, 30, 30), (2, 35, 25)]


def test_repeats_blocks_of_like_halves(spark):
    """Two different blocks of one symbol whose words' keys agree in their upper 32 bits."""
    phrase = " ".join(f"p{k}" for k in range(18))
    rows = [(i, f"a{i} {phrase} b{i}") for i in (7601, 69477)]
    got = by_id(recompression.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all((got[i]["n_removed"], got[i]["kept"]) == (0, t) for i, t in rows)


def test_elections_agree():
    """Equal windows elect equal symbols whatever stands around them."""
    import pyarrow as pa

    r = random.Random(2)
    w = recompression.Words(pa.array([" ".join(r.choice("abcdefgh") for _ in range(3000)) for _ in range(3)] + ["a " * 60]))
    at, _, chosen, start, lo, hi = recompression.elect(w, 6)
    seen = {}
    for p, c in zip(at, chosen):
        g = tuple(w.first[p:p + 6])
        mine = (start[c] - p, lo[c] - p, hi[c] - p) if c >= 0 else None
        assert seen.setdefault(g, mine) == mine and (mine is None or 0 <= mine[1] and mine[2] <= 6)
    assert len(seen) < len(at)


def fingerprint(t, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = words(low)
    sh = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closed(fps, within=4):
    """Smallest index reachable from each fingerprint."""
    n, fps = len(fps), np.array(fps, np.uint64)
    root = list(range(n))
    for _ in range(n):
        new = [min(root[j] for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= within)) for i in range(n)]
        if new == root:
            break
        root = new
    return root


def test_simhash(docs, rows, nothing):
    rows = sorted(rows)
    fps = [fingerprint(t) for _, t, *_ in rows]
    want, got = closed(fps), by_id(simhash.classes(docs))
    assert simhash.classes(nothing).count() == 0
    for k, (i, *_) in enumerate(rows):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fps[k]:016x}", rows[want[k]][0])
    stay = {r["doc_id"] for r in simhash.keep_first(docs).collect()}
    assert stay == {rows[w][0] for w in want}


def shingles(t, size=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def first_of_similar(rows):
    """Ids of the first row of each group connected by a likeness of at least 0.8, by all pairs."""
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {rows[find(i)][0] for i in range(len(rows))}


def test_similar_texts(spark, docs, rows):
    """Edited copies of all degrees, many beyond four bits; with tiny buckets all steps are taken."""
    r = random.Random(3)
    texts = []
    for g in range(30):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(r.choice((8, 60, 200)))]
        for _ in range(6):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 40)):
                w[r.randrange(len(w))] = f"x{r.randrange(10 ** 6)}"
            texts.append(" ".join(w))
    made = list(enumerate(r.sample(texts, len(texts))))
    df, want = spark.createDataFrame(made, "doc_id long, text string"), first_of_similar(made)
    assert len(want) < len({made[w][0] for w in closed([fingerprint(t, 5) for _, t in made])})
    for how in ({}, {"limit": 5, "work": 10}):
        assert {x["doc_id"] for x in similar.keep_first(df, **how).collect()} == want
    assert {x["doc_id"] for x in similar.keep_first(docs).collect()} == first_of_similar([(i, t) for i, t, *_ in rows])


def test_groups_do_not_depend_on_the_size_of_buckets(spark):
    """Pairs of likeness 0.82 that share a frame with all others: small limits lose none of the links that large ones find, and parts may be empty."""
    r = random.Random(8)
    frame, made = [f"f{k}" for k in range(150)], []
    for g in range(120):
        own = [f"g{g}w{k}" for k in range(60)]
        for c in range(2):
            w = frame + own
            for k in range(155 + r.randrange(3), 205, 15) if c else []:
                w[k] = f"x{r.randrange(10 ** 6)}"
            made.append((2 * g + c, " ".join(w)))
    df, want = spark.createDataFrame(made, "doc_id long, text string"), first_of_similar(made)
    assert len(want) == 120
    for how in ({}, {"limit": 3, "work": 1}):
        assert {x["doc_id"] for x in similar.keep_first(df, **how).collect()} == want


def test_features_are_made_in_small_pieces():
    """What the classifier makes of one piece of text stays small."""
    import tracemalloc
    import pyarrow as pa

    texts = pa.array(["some short words of one text " * 40] * (quality.PIECE // 1160))
    tracemalloc.start()
    quality.features(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20


def test_training_reads_rows_as_they_are():
    import tracemalloc

    import numpy as np

    r = np.random.default_rng(4)
    rows = [(k % 2, np.sort(r.integers(0, quality.DIMS, 2000)).astype(np.int32), r.random(2000).astype(np.float32)) for k in range(1500)]
    tracemalloc.start()
    quality.ftrl(rows, epochs=1, alpha=2.0, beta=0.01, l1=1e-4, l2=1e-4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20  # the rows hold 24 MB and were copied as twice that


def test_near_copies_give_few_links():
    """A bucket of near copies gives one link less than its sets, and buckets that share sets share most links."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, similar.SHORT, np.uint64)
    sig = r.integers(-(1 << 62), 1 << 62, 400)
    fps = [(base ^ np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in r.integers(0, 64, 2)])).tobytes() for _ in sig]
    kind = pa.list_(pa.struct([("sig", pa.int64()), ("fp", pa.binary())]))
    take = lambda some: [{"sig": int(sig[i]), "fp": fps[i]} for i in some]
    lists = pa.array([take(range(400)), take(range(20, 400)), take(range(380))], kind)
    out = list(similar._in_buckets(iter([pa.RecordBatch.from_arrays([pa.array([0, 1 << 12, 2 << 12]), lists], ["bucket", "sets"])])))[0].to_pydict()
    assert len(out["a"]) == 399 + 379 + 379 and set(out["again"]) == {0, 1 << 12, 2 << 12}
    assert len({frozenset(p) for p in zip(out["a"], out["b"])}) < 500


def test_jobs_do_not_grow_with_a_bucket(spark):
    """Texts that share a frame of 60 words but are not alike, beside a group of near copies: the number of Spark jobs is bounded by the levels."""
    r = random.Random(6)
    frame = [f"f{k}" for k in range(60)]
    near = [f"n{k}" for k in range(120)]
    made = [(k, " ".join(frame + [f"x{r.randrange(10 ** 6)}" for _ in range(25)])) for k in range(500)]
    made += [(1000 + k, " ".join(near[:k] + ["y"] + near[k + 1:])) for k in range(20, 100)]
    jobs = []
    for n in (50, 500):
        rows = made[:n] + made[500:]
        spark.sparkContext.setJobGroup(f"frame{n}", "")
        got = {x["doc_id"] for x in similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), limit=40, work=200).collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"frame{n}")))
        assert got == first_of_similar(rows)
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[1] <= similar.LEVELS * jobs[0], jobs  # large buckets are cut at most twice


def test_links_through_large_buckets(spark):
    """With tiny buckets all three rounds of blocks are taken, and no connection is lost."""
    r = random.Random(4)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(14):
            fps.add(x)
            for b in r.sample(range(64), r.randrange(1, 6)):
                x ^= 1 << b
    fps = sorted(fps)
    signed = [simhash._signed(x) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = [(a, b) for a, b in simhash.close_links(df, bucket=2).collect()]
    un = lambda x: x & ((1 << 64) - 1)
    assert all((un(a) ^ un(b)).bit_count() <= 4 for a, b in links)
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closed(fps)
    groups = defaultdict(set)
    for k, x in enumerate(signed):
        groups[want[k]].add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    n = 70
    r = random.Random(8)
    names = r.sample(range(1000), n)
    got = simhash.components(spark.createDataFrame(list(zip(names, names[1:])) + [(5000, 5001)], "a long, b long")).collect()
    assert {x["root"] for x in got if x["node"] < 5000} == {min(names)} and (5001, 5000) in {(x["node"], x["root"]) for x in got}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def goals(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(w[s] for s in free)
        more = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= more


def test_mixing(docs, rows, nothing):
    got = by_id(mixing.mix(docs, block=16, shard=64))
    assert mixing.mix(nothing).count() == 0 and by_id(mixing.mix(docs, block=16, shard=64)) == got
    total, taken = Counter(), Counter()
    for i, t, _, s, _ in rows:
        total[s] += len(words(t))
    goal = goals(total)
    for i, t, _, s, _ in rows:
        r = got[i]
        assert (r["size"], r["source_size"]) == (len(words(t)), total[s]) and abs(r["target"] - goal[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.5 + 1e-6 for s in goal)


def spark_hash(*values):
    """Spark's xxhash64 of longs, ints and strings."""
    h = 42
    for kind, v in values:
        h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else v.to_bytes(8 if kind == "l" else 4, "little", signed=True), seed=h)
    return h - (1 << 64) if h >> 63 else h


def permuted(x, n, seed, key, turn):
    for r in range(1, mixing.ROUNDS + 1):
        other = (spark_hash(("i", seed), ("s", key), ("l", turn), ("i", r)) % n - x) % n
        if spark_hash(("i", seed), ("s", key), ("l", turn), ("i", r), ("l", max(x, other))) & 1:
            x = other
    return x


def test_mixing_slots_against_a_plain_twin(spark):
    """Sources of 1 to 10 blocks, capped and not: taken words per document from the permutations themselves, totals at the target."""
    r = random.Random(8)
    rows = []
    for k, size in enumerate([20, 60, 129, 300, 128, 900, 1279, 5000, 40000]):
        while size > 0:
            n = min(size, r.randint(1, 400))
            rows.append((len(rows), " ".join(["w"] * n), f"s{k}"))
            size -= n
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = by_id(mixing.mix(docs))
    total, taken = Counter(), Counter()
    for i, t, s in rows:
        total[s] += len(words(t))
        taken[s] += got[i]["taken"]
    goal = goals(total)
    assert all(abs(taken[s] - goal[s]) <= 0.5 + 1e-6 for s in goal) and all(taken[s] == 3 * total[s] for s in goal if goal[s] == 3 * total[s])
    block = mixing.BLOCK
    for s in total:
        own = sorted((spark_hash(("l", i)) % mixing.PARTS, i, len(words(t))) for i, t, x in rows if x == s)
        whose = [i for _, i, n in own for _ in range(n)]
        n, left, turn, want = -(-len(whose) // block), round(goal[s]), 0, Counter()
        while left:
            for x in range(n):
                if left:
                    b = permuted(x, n, 1, "s" + s, turn)
                    part = whose[b * block:(b + 1) * block][:left]
                    want.update(part)
                    left -= len(part)
            turn += 1
        assert {i: got[i]["taken"] for _, i, _ in own} == {i: want[i] for _, i, _ in own}, s


def test_mixing_shards_are_multinomial_draws(spark):
    rows = spark.createDataFrame([("a", "sa", 128 * 6000, 1.0, 128 * 6000.0), ("b", "sb", 128 * 3000, 1.0, 128 * 3000.0)], "source string, key string, source_size long, weight double, target double")
    got = mixing.slots(rows, shard=100).groupBy("shard", "key").count().collect()
    a = [r["count"] for r in got if r["key"] == "sa"]
    assert len({r["shard"] for r in got}) == 90 and sum(a) == 6000
    spread = np.var(a + [0] * (90 - len(a))) / (6000 / 90 * 89 / 90)
    assert 0.6 < spread < 1.5  # the variance of multinomial counts


def test_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    names = ["pass", "words", "row", "__words", "c1", "body", "id", "w", "taken", "key", "block", "sig", "k", "b", "part"]
    odd = docs.select("*", *[F.lit(1).alias(n) for n in names])
    assert mixing.mixed(odd).columns == odd.columns == similar.keep_first(odd).columns
    assert sorted(map(str, similar.keep_first(odd).select(*docs.columns).collect())) == sorted(map(str, similar.keep_first(docs).collect()))
    assert sorted(map(str, mixing.mixed(odd).select("doc_id", "text").collect())) == sorted(map(str, mixing.mixed(docs).select("doc_id", "text").collect()))


def test_mixed_texts(docs, rows):
    text = {i: words(t) for i, t, *_ in rows}
    out = mixing.mixed(docs, block=16, shard=64)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert not Counter(words(r["text"])) - Counter(text[r["doc_id"]])
    want = {i: r["taken"] for i, r in by_id(mixing.mix(docs.repartition(3), block=16, shard=64)).items()}
    assert abs(sum(got.values()) - sum(want.values())) <= 8 and all(n <= 3 * len(text[i]) for i, n in got.items())


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit("s"), F.lit(0)).alias("p"))
        p = [r["p"] for r in df.collect()]
        assert sorted(p) == list(range(n)) and (n < 50 or p != list(range(n)))


def test_pipeline(spark, tmp_path):
    rows = [r for r in sample(9, 60)]
    clean = " ".join(f"plain word{k} here." for k in range(80))
    rows += [(1000 + k, clean if k < 3 else clean.replace("word7 ", "other "), "en", "s1", 0) for k in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("***" not in (t or ""))) for i, t, *_ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = read
        out = stage(spark, read, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS, name
        out.write.parquet(f"{tmp_path}/{stage.__name__}")
        read = spark.read.parquet(f"{tmp_path}/{stage.__name__}")
        a, b = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (before, read))
        if stage is corpus_pipeline.near_dedup:
            assert set(b) == first_of_similar(list(a.items())) and all(b[i] == a[i] for i in b)
        if stage is corpus_pipeline.classify:
            kept = {r["doc_id"] for r in quality.score(before.withColumn("t", before["text"]), quality.model_of(quality.train(before, spark.read.parquet(f"{tmp_path}/labels.parquet").filter(~quality.held_out()))), text="t").filter("score >= 0.5").collect()}
            assert set(b) == kept and all(b[i] == a[i] for i in b)
        if stage is corpus_pipeline.mix_sources:
            goal = goals(Counter({k: v for k, v in ((x["source"], sum(len(words(r["text"])) for r in before.collect() if r["source"] == x["source"])) for x in before.select("source").distinct().collect()) if v}))
            got = Counter()
            for r in out.collect():
                got[r["source"]] += len(words(r["text"]))
            assert all(abs(got[k] - goal[k]) <= 1 for k in goal)
        if stage is corpus_pipeline.cut_repeats:
            want = cut(list(a.items()))
            assert b == {i: (a[i] if not gone else kept) for i, (n, gone, kept) in want.items() if not gone or gone < n}
    last = corpus_pipeline.STAGES[-1][1](spark, read, str(tmp_path)).collect()
    assert {r["decoded_sha256"] for r in last} == {hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in read.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in whole) == Counter((r["doc_id"], r["ids_sha256"]) for r in last)
