"""Language model, classifiers and packing: exact parts against brute force, models by what they get right."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cborlake.llm import gam, lm_scoring, packing, textvec, toxicity
from cborlake.llm.queries import tokenizer_path

LEARNS = lambda x: F.crc32(x.cast("string")) % 7 != 2


def test_words_and_shingles():
    texts = [b"", b" a  b\tc\n", b"one two three four five six", "é x".encode(), b"one two three four five six seven"]
    h, begins = textvec.words(texts)
    alone = [textvec.words([t])[0].tolist() for t in texts]
    assert [h[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == alone
    assert [len(a) for a in alone] == [len(t.split()) for t in texts]
    assert [len(s) for s in textvec.shingles(texts)] == [0, 1, 2, 1, 3]
    assert len(np.intersect1d(textvec.shingles(texts)[2], textvec.shingles(texts)[4])) == 2


def test_language_model(spark, odd_docs, prose):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(100 + k, prose(150, k)) for k in range(150)] + [(400, "Zz qq " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS uid", "2 AS bits", "3 AS token").repartition(3)
    out = lm_scoring.score(docs, LEARNS).collect()
    learned = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for t in learned for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        want.append((i, i is None or zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4)))
    assert sorted([(*r[:5], round(r[5], 4)) for r in out], key=repr) == sorted(want, key=repr)
    held = [r for r in out if r["held_out"] and r["doc_id"] and 100 <= r["doc_id"] < 400]
    assert np.mean([r["bits_per_byte"] for r in held]) < 2.6  # 8 with no model, about 1.7 for a perfect one
    assert next(r for r in out if r["doc_id"] == 400)["score"] < 0
    again = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, LEARNS).collect() if r["doc_id"] and r["doc_id"] >= 100}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in out if r["doc_id"] in again)
    assert lm_scoring.score(docs.limit(0), LEARNS).count() == 0
    assert lm_scoring.score(docs, lambda x: F.lit(False)).where("score < 0").count() == len(rows)


def test_model_is_a_distribution():
    """The probabilities of all symbols after a text sum to one."""
    trainer = lm_scoring.Trainer()
    for k in range(5):
        trainer.step([bytes(random.Random(k).choices(b"abc de", k=4000))])
    centre = np.log((trainer.map[0] + 1e-4) / (trainer.map[1] - trainer.map[0] + 1e-4))
    model = lm_scoring.Model([lm_scoring._cell(*lm_scoring._halves(c)) for c in trainer.counts], trainer.weights, np.clip(centre, -lm_scoring.BOUND, lm_scoring.BOUND))
    for text in (b"", b"a", b"abc de", b"zz", "é".encode()):
        _, contexts, codes, _ = lm_scoring._keys([text])
        costs = model.costs(np.arange(257), [np.repeat(c[codes[-1]], 257) for c in contexts])
        assert (2.0**-costs).sum() == pytest.approx(1.0)
    assert model.bits([b"abc", b"", b"abc"]).tolist() == pytest.approx([model.bits([t])[0] for t in (b"abc", b"", b"abc")])


def test_contexts_depend_on_nothing_else():
    """A symbol's contexts are the same wherever its text stands, and do not tell capitals apart within a word."""
    texts = [b"The end", b"", b"x THE END", b"the end", b"ab" * 400]
    symbol, contexts, codes, begins = lm_scoring._keys(texts)
    for k, t in enumerate(texts):
        own = lm_scoring._keys([t])
        w = slice(begins[k], begins[k] + len(t) + 1)
        assert symbol[codes[w]].tolist() == own[0][own[2]].tolist() == [*t, 256]
        for c, o in zip(contexts, own[1], strict=True):
            assert c[codes[w]].tolist() == o[own[2]].tolist()
    word = lambda k, at: [contexts[j][codes[begins[k] + at]] for j in (2, 3, 4)]
    assert word(0, 6) == word(2, 8) == word(3, 6) != word(3, 5)


def clean(rng, prose):
    return prose(rng.randrange(30, 120))


def test_quality(spark, prose, odd_docs):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        text = clean(rng, prose)
        if bad:
            kind = k % 3
            text = " ".join(w + "###" for w in text.split()) if kind == 0 else text.upper() + "!!" if kind == 1 else " ".join(x for w in text.split()[:9] for x in [w] * 9)
        rows.append((k, text))
        labels.append((k, 0 if bad else 1))
    labels += [(None, 1), (3, None), (5, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select((F.col("doc_id") + 5000).alias("doc_id"), "text")).selectExpr("*", "1 AS id", "2 AS x")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r["doc_id"]: r["score"] for r in gam.classify(docs, known, lambda x: x % 5 != 0).collect()}
    held = [(out[k], y) for k, y in labels if k is not None and y in (0, 1) and k % 5 == 0]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.97
    assert all(0 <= s <= 1 for s in out.values()) and None in out
    assert {r["score"] for r in gam.classify(docs, known.limit(0), lambda x: x % 5 != 0).collect()} == {0.5}
    assert gam.classify(docs.limit(0), known, lambda x: x % 5 != 0).count() == 0


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:2000], y[:2000])
    assert np.mean((model.score(x[2000:]) > 0.5) == y[2000:]) > 0.9


def test_toxicity(spark, prose, odd_docs):
    rng = random.Random(2)
    bad = ["blockhead", "nincompoop", "scoundrel", "dunderhead"]
    rows, labels = [], []
    for k in range(900):
        words = clean(rng, prose).split()
        toxic = k % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words) + "."))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select((F.col("doc_id") + 5000).alias("doc_id"), "text")).selectExpr("*", "1 AS id", "2 AS margin")
    known = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int")
    learn = lambda x: x % 3 != 1
    out = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, known, learn).collect()}
    assert np.mean([(out[k] >= 0.7) == bool(y) for k, y in labels if k % 3 == 1]) > 0.98
    model = toxicity.model_of(docs, known, learn)
    score = lambda t: model.score(model.worst([t]))[0]
    for word in ("block-head", "bloxckhead", "b l o c k h e a d", "nincom.poop", "BLOCKHEAD", "scounXdrel"):
        assert score(f"so he said you {word} and left") > score("so he said you water and left") + 0.3, word
    assert score("") < 0.3 and score(prose(2000)) < 0.3
    kept = toxicity.keep_below(docs, model, 0.7)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.7 for s in [*out.values()]) + 1  # a repeated row counts twice
    assert toxicity.classify(docs.limit(0), known, learn).count() == 0
    assert {r["score"] for r in toxicity.classify(docs, known.limit(0), learn).collect()} == {0.0}


def brute_kernel(a, b):
    """By the definition: subsequences of 4 and 5 characters that begin in a window's own characters, with one gap at most."""

    def features(window):
        text, own = window
        out, power = collections.Counter(), 0.0
        for at in range(own):
            for n in (4, 5):
                for rest in itertools.combinations(range(1, n + toxicity.GAP), n - 1):
                    if at + rest[-1] < len(text) and rest[-1] - n + 1 <= toxicity.GAP:
                        out["".join(text[at + k] for k in (0, *rest))] += toxicity.DECAY ** (rest[-1] + 1)
                        power += toxicity.DECAY ** (2 * rest[-1] + 2)
        return out, max(power, 1e-12) ** 0.5

    (x, px), (y, py) = features(a), features(b)
    return sum(v * y[u] for u, v in x.items()) / (px * py)


def test_string_kernel_and_landmarks(prose):
    texts = [prose(30, k) + ". You are a blockhead! " + prose(3, 90 + k) for k in range(6)] + ["a", "", "abcd", "no " * 40, "x" * 200]
    found = toxicity.windows(texts)
    examples = found.examples(np.arange(len(found.start)))
    rows = toxicity.occurrences(examples)
    want = [[brute_kernel(a, b) for b in examples[:12]] for a in examples]
    some = rows[0] < 12
    for often in (0, 8, 1000):  # whichever way slots are multiplied
        got = toxicity.kernel(rows, len(examples), tuple(x[some] for x in rows), 12, often=often, block=64)
        off = np.abs(got - want)  # subsequences may share a slot
        assert np.mean(off < 1e-4) > 0.9 and off.max() < 0.05
    root = toxicity.nystroem(got[:12])
    features = got[:12] @ root
    assert np.abs(features @ features.T - got[:12]).max() < 0.01


def test_windows_cover_sentences(prose):
    """Neighbouring words of a sentence share a window, windows do not cross sentences, every letter is in one."""
    texts = ["One two three. Four five six seven eight nine ten", "a b c d idle\nnext", "", "!?", "w" * 500 + " end", "i-d.i_o't ok", "x. y"]
    found = toxicity.windows(texts)
    seen = collections.defaultdict(list)
    for (text, own), k in zip(found.examples(np.arange(len(found.start))), found.text.tolist(), strict=True):
        seen[k].append(text[:own])
    assert seen[0] == [" one two three ", " four five six seven", " six seven eight nine", " eight nine ten "]
    assert seen[1] == [" abcd idle ", " next "] and 2 not in seen and 3 not in seen and seen[5] == [" idiot ok "] and seen[6] == [" x ", " y "]
    assert max(map(len, seen[4])) <= 2 + 4 * toxicity.UNIT and sum(map(len, seen[4])) >= 500
    model = toxicity.Model(np.random.default_rng(0).normal(size=toxicity.SLOTS).astype(np.float32), 0.5, 1.0, 0.0)
    assert np.allclose(model.worst(texts), [model.worst([t])[0] for t in texts])
    examples = found.examples(np.arange(len(found.start)))
    row, slot, weight = toxicity.occurrences(examples)
    assert np.allclose(model.margins(found), np.bincount(row, weight * model.table[slot], len(examples)) + 0.5, atol=1e-4)


def test_phrases_are_learned(spark, prose):
    """An insult may be made of words that clean documents have, too: none of them tells by itself."""
    rng = random.Random(21)
    rows = []
    for k in range(900):
        words = prose(rng.randrange(30, 60), 3000 + k).split()
        phrase = ["go", "back", "home", "now"]
        if k % 4 == 0:
            words[rng.randrange(len(words)) : 0] = phrase
        else:
            for x in rng.sample(phrase, 4):
                words.insert(rng.randrange(len(words)), x)
        rows.append((k, " ".join(words) + ".", int(k % 4 == 0)))
    model = toxicity.train(spark.createDataFrame([r for r in rows if r[0] % 3], "id long, text string, y int"))
    held = [r for r in rows if r[0] % 3 == 0]
    low = model.score(model.worst([r[1] for r in held])) >= 0.7
    assert np.mean(low == np.array([r[2] for r in held])) > 0.9


def test_encoder_equals_the_tokenizer(prose):
    encode = packing.Encoder(tokenizer_path(), cache=50)
    texts = ["", " ", "a  b\n\n c\t\td ’x <|endoftext|> y", " é² 12ab's IT'S it's we'll\r\n x ", "漢字 и текст ", "naïve x", prose(300), "x" * 5000, "\x1c\x85 a", "-- !! ## a_b ~"]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, odd_docs, prose):
    docs = odd_docs.unionByName(odd_docs.selectExpr("doc_id + 100 AS doc_id", "concat(text, ' more') AS text", *[f"`{c}`" for c in odd_docs.columns[2:]])).repartition(3)
    out = packing.pack(docs, tokenizer_path()).collect()
    encode = packing.Encoder(tokenizer_path())
    want = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*np.frombuffer(encode([r["text"] or ""])[0], "<u4").tolist(), 2]
        start = 0
        lengths = [len(ids)] if len(ids) <= 1024 else [*([len(ids) % 1024] if len(ids) % 1024 else []), *[1024] * (len(ids) // 1024)]
        for k, n in enumerate(lengths):
            want[r["doc_id"], k, start, n, tuple(ids[start : start + n])] += 1
            start += n
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_best_two_fit(seed):
    rng = random.Random(seed)
    counts = collections.Counter(rng.choice([rng.randrange(1, 1024), rng.randrange(1, 200), 600, 1023, 1]) for _ in range(rng.randrange(1, 3000)))
    counts[37] += 10**9 * (seed == 4)
    patterns = packing.best_two_fit(dict(counts))
    used = collections.Counter()
    for lengths, times in patterns:
        assert times > 0 and 0 < sum(lengths) <= 1024
        for x in lengths:
            used[x] += times
    assert used == counts and len(patterns) < 5000
    bins, least = sum(t for _, t in patterns), -(-sum(k * v for k, v in counts.items()) // 1024)
    assert bins <= 1.08 * max(least, sum(v for k, v in counts.items() if k > 512)) + 2


def test_replacement_of_the_smallest():
    """600 + 300 leaves 124: 300 gives way to 210 and 214, which fill the bin."""
    assert packing.best_two_fit({600: 1, 300: 1, 214: 1, 210: 1})[0] == ([600, 214, 210], 1)


def test_scoring_gives_up_its_tables(spark):
    """What only earlier steps need is gone when texts are scored, and results are still read in full."""
    from cborlake.llm import common, lm_scoring

    before = set(common._scratch)
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(20)], "doc_id long, text string")
    out = lm_scoring.score(docs, lambda x: x % 2 == 0)
    left = {p.rsplit("/", 1)[1].split("-")[1] for p in set(common._scratch) - before}
    assert left == {"words", "scored"}
    assert out.where("score < 0").count() == 20
