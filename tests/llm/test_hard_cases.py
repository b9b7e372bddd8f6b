"""Texts written to break hashes, very long texts, repeated and null ids, and brute force for trained models."""

import hashlib
import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import bpe, kernel, minhash, quality, secrets, substring, tokenfiles, topk, toxicity, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


S, T = thue_morse(2048), thue_morse(2048, "b", "a")


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None) for i, t in enumerate(texts)], SCHEMA)


def test_repetitive_spans_have_hashes_of_their_own():
    data = np.frombuffer((S + T).encode(), np.uint8)
    cuts = [(k, k + n) for n in (8, 16, 64, 256, 1024, 2048) for k in range(0, 4096 - n + 1, n)]
    a, b = np.array(cuts).T
    h = kernel.span_hash(data, a, b)
    assert len(set(h.tolist())) == len({(S + T)[x:y] for x, y in cuts})
    words = np.array([1, 2], np.uint64)[[bin(i).count("1") & 1 for i in range(8192)]]
    for width in (2, 3, 20, 50, 1024, 2048):
        runs = {tuple(words[i : i + width].tolist()) for i in range(0, 8192 - width)}
        assert len(set(kernel.run_hash(words, width)[: 8192 - width].tolist())) == len(runs)


def test_encoders_on_repetitive_words(spark):
    text = f"x {S} {T} {S[:300]} {T[:300]}"
    for op, path, end in ((bpe, bpe.default_path(), []), (tokenfiles, tokenfiles.default_path(), [1])):
        library = Tokenizer.from_file(path)
        want = library.encode(text, add_special_tokens=False).ids + end
        if op is bpe:
            got = bpe.encode(frame(spark, [text])).first()["ids"]
        else:
            folder = tokenfiles.scratch_path(spark, "ids")
            tokenfiles.write(frame(spark, [text]), folder)
            got = tokenfiles.read(spark, folder).first()["ids"]
        assert got == want


def test_a_collision_in_the_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(kernel, "span_hash", lambda data, start, end: np.full(len(start), 7, np.uint64))
    cache, data = kernel.SpanCache(), np.frombuffer(b"alphabetical betabetabet alphabetical ab", np.uint8)
    start, end = np.array([0, 13, 25, 38]), np.array([12, 24, 37, 40])
    make = lambda spans: [[len(s), s[0]] for s in spans]
    for _ in range(2):
        ids, count = cache.lists(data, start, end, make)
        assert ids.tolist() == [12, 97, 11, 98, 12, 97, 2, 97] and count.tolist() == [2] * 4


def test_repetitive_texts_are_told_apart(spark):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, [f"{S} z", f"{T} z", f"{S} z"]), width=2).collect()}
    assert [got[i]["component_id"] for i in range(3)] == [0, 1, 0]
    assert quality.judge(frame(spark, [f"{S}\n{T}\n{S}"])).first()["n_dup_lines"] == 1
    a, b = ([w + x for x in thue_morse(64)] for w in ("p", "q"))
    rows = [" ".join(a), " ".join(b), " ".join([*a[:10], *b[10:]]), " ".join(a[3:60])]
    out = {r["doc_id"]: r["n_removed"] for r in substring.report(frame(spark, rows)).collect()}
    seen, want = {}, {}
    for i, t in enumerate(rows):
        w, gone = t.split(), set()
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) < i:
                gone |= set(range(k, k + 50))
        want[i] = len(gone)
    assert out == want and want[3] == 57


@pytest.fixture(scope="module")
def long_text():
    rnd = np.random.default_rng(3)
    vocab = ["".join(rnd.choice(list("abcdefghijklm"), rnd.integers(2, 9))) for _ in range(500)]
    return " ".join(vocab[i] for i in rnd.integers(0, 500, 300_000))  # about two slices


def test_very_long_texts(spark, long_text):
    docs = frame(spark, ["short words here", long_text, long_text + " end", None])
    ids = Tokenizer.from_file(bpe.default_path()).encode(long_text, add_special_tokens=False).ids
    r = {x["doc_id"]: x for x in bpe.encode(docs, digest=True, ids=False).collect()}
    assert r[1]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r[1]["decoded_sha256"] == hashlib.sha256(long_text.encode()).hexdigest()
    r = {x["doc_id"]: x for x in tokenfiles.round_trip(docs).collect()}
    want = Tokenizer.from_file(tokenfiles.default_path()).encode(long_text, add_special_tokens=False).ids + [1]
    assert r[1]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes()) and r[3]["n_tokens"] == 1
    r = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs).collect()}
    assert r == {0: 0, 1: 1, 2: 1, 3: 3}
    r = {x["doc_id"]: x for x in substring.report(docs).collect()}
    assert (r[1]["n_removed"], r[2]["n_removed"], r[2]["kept_sha256"]) == (0, 300_000, hashlib.sha256(b"end").hexdigest())
    assert {x["doc_id"]: x["n_words"] for x in quality.judge(docs).collect()} == {0: 3, 1: 300_000, 2: 300_001, 3: 0}
    assert secrets.scan(frame(spark, [long_text + " password=abcdefgh1234"])).first()["n_assign"] == 1
    assert toxicity.score(docs, toxicity.Machine(0.0, np.zeros(toxicity.DIM), np.zeros((toxicity.DIM, 1)))).filter("score = 0.5").count() == 4
    url = "http://a.org/" + "x/" * 100_000
    pages = spark.createDataFrame([(1, url), (1, url), (2, None)], "page_id long, url string").withColumn("tokens", F.lit(1)).withColumn("rule", F.lit("own"))
    assert [(r["page_id"], r["verdict"]) for r in sorted(urlfilter.judge(pages).collect(), key=lambda r: r["page_id"])] == [(1, "allow"), (1, "allow"), (2, "allow")]


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two three", None, None, None), (5, "one two three", "en", "s", 1), (5, "one two three", "en", "s", 1), (-(1 << 63), "last", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("x")).withColumn("score", F.lit("y"))
    order = lambda rows: sorted(rows, key=str)
    assert order(r["doc_id"] for r in bpe.encode(docs).collect()) == order(r[0] for r in rows)
    assert order(r["doc_id"] for r in tokenfiles.round_trip(docs).collect()) == order(r[0] for r in rows)
    labels = spark.createDataFrame([(5, 1), (5, 1), (None, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 4 and len({r["score"] for r in got if r["doc_id"] == 5}) == 1 and not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_queries_of_one_id_are_ranked_together(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=4).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 3 << 16), (2, 2, 2 << 16), (3, 2, 2 << 16), (4, 1, 0)]


def test_top_k_beyond_doubles_and_in_waves(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.integers(-(1 << 20), 1 << 20, 5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    w, counts = {i: [int(256 * x) for x in v] for i, v in rows}, {}
    want = []
    for q in range(0, 300, 10):
        best = sorted((-sum(a * b for a, b in zip(w[q], w[c])), c) for c in w if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, wave=7, head=2, counts=counts).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert counts["pairs"] == 30 * 300 and counts["by_partial_sums"] > 0


def test_factorization_margins_equal_all_pairs():
    rnd = np.random.default_rng(5)
    m = toxicity.Machine(0.3, rnd.normal(size=toxicity.DIM), rnd.normal(size=(toxicity.DIM, toxicity.FACTORS)))
    rows = [rnd.choice(toxicity.DIM, n, replace=False) for n in (0, 1, 2, 7, 30)]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = m.margins(np.concatenate(rows), at)
    for r, x in zip(rows, got):
        pairs = sum(m.factor[a] @ m.factor[b] for a, b in itertools.combinations(r, 2))
        assert abs(x - (m.bias + m.weight[r].sum() + pairs)) < 1e-9


def _objective(rows):
    return quality._sound(np.cov(rows.T, bias=True))[1]


@pytest.mark.parametrize("seed,n,far", [(0, 8, 2), (1, 10, 2), (2, 12, 3), (3, 5, 1), (4, 2, 0)])
def test_least_determinant_on_small_groups(spark, seed, n, far):
    """The fit of a small group against every subset of its size."""
    rnd = np.random.default_rng(seed)
    x = np.rint(rnd.normal(0, 200, (n, quality.D))).astype(int)
    x[:far] += 3000
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"x{i}" for i in range(quality.D)]).assign(g="a").astype({f"x{i}": "int64" for i in range(quality.D)}))
    fit = quality.estimates(df).first()
    h = int(np.ceil(quality.SHARE * n))
    best = min((_objective(x[list(c)].astype(float)), c) for c in itertools.combinations(range(n), h))
    assert fit["rows"] == n and fit["det"] <= best[0] + 0.1 * abs(best[0]) + 0.2
    centre = np.array([fit[f"m{i}"] for i in range(quality.D)])
    assert np.abs(centre - x[list(best[1])].mean(0)).max() < 700  # no far row is among the nearest


def test_every_group_has_an_estimate_of_its_own(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    vectors = quality.statistics(docs).filter(~quality.base_failed()).select(F.to_json(F.array("lang", "source")).alias("g"), *quality.rates())
    assert quality.estimates(vectors).count() == vectors.select("g").distinct().count()


def test_dense_and_loose_families(spark):
    """Chains of near-copies and texts alike below the threshold, against all pairs."""
    rnd = np.random.default_rng(6)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(80):
        w = list(base)
        for k in rnd.choice(60, 1 + i % 7, replace=False):
            w[k] = f"n{i}_{k}"
        texts.append(" ".join(w))
    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:])} for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, texts), width=2).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_prefix_pairs_lose_nothing(spark):
    """Every pair of similar sets of different components meets in the prefixes."""
    rnd = np.random.default_rng(7)
    sets = [np.unique(rnd.choice(40, rnd.integers(1, 25))) for _ in range(60)]
    rows = [(i, i, i % 3, [int(x) for x in s]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "doc_id long, component long, tile long, sh array<long>")
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    met = minhash._meetings(df, 80)
    assert want <= {(r["a"], r["b"]) for r in met.collect()}
    assert {(r["a"], r["b"]) for r in minhash._counted(met, df, 80).collect()} == want


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_tables(spark, sf, k, long_text):
    name, stage = corpus_pipeline.STAGES[k]
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, long_text, "en", "s", 1), (2, long_text, "en", "s", 1), (3, "same words", None, "s", 2), (3, "same words", None, "s", 2)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("own")).withColumn("kept", F.lit(7)).withColumn("component_id", F.lit("c"))
    got = stage(spark, docs, sf)
    assert got.count() <= 2 * len(rows)
    if k + 1 < len(corpus_pipeline.STAGES):
        assert got.columns == docs.columns
    assert stage(spark, docs.limit(0), sf).count() == 0
