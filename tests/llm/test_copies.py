"""Near-duplicates of texts and vectors, repeated passages, components; each against brute force."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cborlake.llm import embed_dedup, induced, ngram_join, suffix_dedup
from cborlake.llm.components import components


def roots(nodes, links):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == roots(nodes, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 64)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 24))
    rows = [(k, [float(x) for x in base[k % 40] + rng.normal(size=24) * rng.choice([0, 0.1, 0.3, 0.45])]) for k in range(400)]
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] * 24), (504, [None] + [1.0] * 23), (None, rows[0][1]), (505, rows[1][1]), (506, [2 * x for x in rows[1][1]]), (507, rows[2][1][:12]), (508, [1e300] * 24), (509, [1e-300] * 24), (510, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "2 AS uid", "3 AS node")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df).collect()}
    good = {k: np.array(v) / np.abs(v).max() for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.9]
    top = roots([k for k, _ in rows if k is not None], links)
    assert len(links) > 300
    assert got == {k: (sum(k in x for x in links), top[k], top[k] == k) for k in top} | {None: (0, None, True)}
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_in_rounds(spark, monkeypatch):
    """Blocks of two tiles, as many tiles a round as there are in all: links as by brute force, no shuffle files left by a
    round, and each two tiles of near leaves meet once."""
    for name, value in (("TILE", 8), ("BLOCK_BYTES", 8 * 6 * 8 * 2), ("ROUND_BYTES", 0)):
        monkeypatch.setattr(embed_dedup, name, value)
    sent, whole = [], embed_dedup._rounds
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")

    def rounds(units, most):
        for r in whole(units, most):
            least = min([files(), *(f for f, _, _ in sent)])
            for _ in range(50):  # files go a little after their query
                if files() > least:
                    time.sleep(0.1)
            sent.append((files(), len(r), most))
            yield r

    monkeypatch.setattr(embed_dedup, "_rounds", rounds)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 6))
    x = np.concatenate([base[k % 30] + rng.normal(size=6) * rng.choice([0, 0.2, 0.4]) for k in range(240)]).reshape(-1, 6)
    x[::40, 0], x[1::40, 0] = 0.0, -0.0
    x[1::40, 1:] = x[::40, 1:]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    links = [(a, b) for a in range(240) for b in range(a + 1, 240) if u[a] @ u[b] >= 0.9]
    top = roots(range(240), links)
    assert got == {k: (sum(k in p for p in links), top[k]) for k in range(240)}
    assert len(sent) > 2 and all(f <= sent[0][0] and n <= most for f, n, most in sent)

    leaf, near = np.repeat(np.arange(7), [1, 3, 1, 2, 1, 4, 1]), rng.random((7, 7)) < 0.4
    near |= near.T | np.eye(7, dtype=bool)
    for block in (1, 2, 5, 20):
        units = list(embed_dedup._units(leaf, near, block))
        met = [tuple(sorted((t, group[q][0]))) for group in units for t, meets in group for q in meets]
        assert sorted(met) == [(a, b) for a in range(13) for b in range(a, 13) if near[leaf[a], leaf[b]]]
        assert all(len(group) <= 2 * block for group in units)


def test_posterior():
    from math import comb

    n = 32
    least = ngram_join.least_agreeing(n)
    xs = np.linspace(0.8, 1, 20001)
    for m in (least - 1, least):
        mass = np.trapezoid((n + 1) * comb(n, m) * xs**m * (1 - xs) ** (n - m), xs)
        assert (mass >= ngram_join.TOLERANCE) == (m >= least)


def shingle_set(text):
    w = (text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_texts(spark, odd_docs, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 16)
    rng = random.Random(9)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for g in range(6):
        words = prose(120, 100 + g).split()
        for k in range(25):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                own[rng.randrange(120)] = f"w{rng.randrange(99)}"
            rows.append((1000 + 100 * g + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS uid", "2 AS key", "3 AS `a.b`")
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    top = roots(range(len(rows)), links)
    least = {t: min((rows[k][0] for k in top if top[k] == t and rows[k][0] is not None), default=None) for t in top.values()}
    want = sorted(((rows[k][0], sum(k in x for x in links), least[top[k]]) for k in top), key=repr)
    got = ngram_join.links(docs).collect()
    assert sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in got), key=repr) == want
    assert sum(r["kept"] for r in got) == len(set(top.values()))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((r["doc_id"] for r in got if r["kept"]), key=repr)
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_shared_blocks_do_not_tie(spark):
    """Documents of common blocks, alike by a third at most: chance collisions of a band make no large groups."""
    rng = random.Random(12)
    blocks = [" ".join(f"b{k}w{j}" for j in range(60)) for k in range(60)]
    rows = [(k, " ".join(rng.sample(blocks, 3)) + " " + " ".join(f"own{k}x{j}" for j in range(20))) for k in range(3_000)]
    rows += [(9_000 + k, rows[k][1] + " tail") for k in range(0, 3_000, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    feats = ngram_join.features(docs, "doc_id", "text")
    classes = feats.where("key IS NOT NULL").select(F.col("uid").alias("node"), "sig", "key")
    ties = ngram_join.candidates(classes)
    groups = components(ties).groupBy("component").count()
    assert groups.agg(F.max("count")).first()[0] < 60
    got = {r["doc_id"]: r["class_id"] for r in ngram_join.links(docs).collect()}
    sets = {k: shingle_set(t) for k, t in rows}
    assert all(got[9_000 + k] == got[k] for k in range(0, 3_000, 50))
    for k, c in got.items():  # whatever is in one class is alike
        if c != k and c != got.get(k - 9_000):
            assert len(sets[k] & sets[c]) >= 0.5 * len(sets[k] | sets[c])


@pytest.mark.parametrize("tile", [2, 16, 512])
def test_ties_connect_all_that_agree(spark, prose, monkeypatch, tile):
    """Against all pairs that share a band and agree in the posterior."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = random.Random(31)
    rows = []
    for g in range(5):
        words = prose(90, 300 + g).split()
        for k in range(30):
            own = list(words)
            for _ in range(rng.randrange(12)):
                own[rng.randrange(90)] = f"w{rng.randrange(99)}"
            rows.append((100 * g + k, " ".join(own)))
    feats = ngram_join.features(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").dropDuplicates(["key"])
    classes = feats.select(F.col("uid").alias("node"), "sig", "key")
    found = {r["node"]: np.frombuffer(bytes(r["sig"]), np.uint32) for r in classes.collect()}
    node, sig = np.array(list(found)), np.stack(list(found.values()))
    i, j = ngram_join._agree(sig, sig, True)
    band = (sig[i].reshape(-1, ngram_join.BANDS, ngram_join.ROWS) == sig[j].reshape(-1, ngram_join.BANDS, ngram_join.ROWS)).all(2).any(1)
    want = roots(node.tolist(), list(zip(node[i[band]].tolist(), node[j[band]].tolist(), strict=True)))
    got = {r["node"]: r["component"] for r in components(ngram_join.candidates(classes)).collect()}
    assert {n: got.get(n, n) for n in node.tolist()} == want and len(set(want.values())) > 5


@pytest.mark.parametrize("memory", [3, 10**6])
def test_suffix_order(memory):
    rng = np.random.default_rng(2)
    for _ in range(150):
        depth = int(rng.integers(1, 20))
        text = np.append(rng.integers(1, 1 + rng.integers(1, 6), rng.integers(0, 60)), 0)
        order, prefix = induced.suffixes(text, depth, memory)
        cut = [tuple(text[k : k + depth].tolist()) for k in order]
        assert sorted(order.tolist()) == list(range(len(text))) and cut == sorted(cut)
        for k in range(1, len(cut)):
            same = next((j for j, (a, b) in enumerate(zip(cut[k - 1], cut[k], strict=False)) if a != b), min(map(len, cut[k - 1 : k + 1])))
            assert prefix[k] == same


def brute_repeats(rows):
    last = 2**63 - 1
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(first.get(t[k : k + 50], last), last if i is None else i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < (last if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark, prose):
    rng = random.Random(3)
    base = "".join(rng.choice("ab c") for _ in range(400))
    passages = [prose(60, k) for k in range(4)]
    rows = [(None, base[:120]), (5, None), (6, ""), (7, base[:49]), (3, base[30:200]), (2, base[100:260]), (9, base), (9, base), (1, "x" * 300), (20, "x" * 120 + "é" * 60), (10, "é" * 90), (4, base[:50]), (11, base[10:60] + base[200:300] + base[10:60])]
    rows += [(100 + k, prose(30) + rng.choice(passages) + prose(20) + rng.choice(passages)[: rng.randrange(300)]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS chunk", "2 AS body", "3 AS id", "4 AS `a.b`", "'z' AS _")
    out = suffix_dedup.remove_repeats(docs, keep=tuple(docs.columns)).collect()
    got = sorted([(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["rest"])).hexdigest()) for r in out], key=repr)
    assert got == brute_repeats([(i, (t or "").encode()) for i, t in rows])
    assert all(r["kept"]["chunk"] == 1 and r["kept"]["a.b"] == 4 for r in out)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_long_documents_in_blocks(monkeypatch, prose):
    texts = [prose(3000, 1).encode(), b"", prose(20, 2).encode(), prose(3000, 1).encode()[:9000]]
    whole = suffix_dedup.anchors(texts)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    cut = suffix_dedup.anchors(texts)
    windows = lambda f: {(d, s, h) for h, d, lo, hi in zip(*(x.tolist() for x in f), strict=True) for s in range(lo, hi + 1)}
    assert windows(whole) == windows(cut)


def test_equal_rows_of_one_document(spark, prose):
    text = prose(30, 7)
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r["spans"] for r in suffix_dedup.remove_repeats(docs).collect()] == [[], []]
    assert ngram_join.keep_one(docs).count() == 1
    assert docs.select(F.col("doc_id")).distinct().count() == 1
