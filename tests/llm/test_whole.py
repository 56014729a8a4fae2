"""That nothing is left out: what was once cut by a fixed size."""

import collections
import random

import numpy as np
import pytest

from cborlake.llm import lm_scoring, suffix_dedup, toxicity


def test_contexts_do_not_share_counts():
    """Each context keeps counts of its own, however many there are."""
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=400_000))
    trainer = lm_scoring.Trainer()
    trainer.step([text.encode()])
    words = text.split(" ")
    # the word so far and what follows it: a letter, a space or the end
    pairs = collections.Counter((w[:k], w[k : k + 1] or of < len(words) - 1) for of, w in enumerate(words) for k in range(len(w) + 1))
    keys, n = lm_scoring._halves(trainer.counts[4])
    assert len(keys) == len(pairs) > 300_000 and sorted(n.tolist()) == sorted(pairs.values())


def test_counts_of_all_chunks_meet(spark, prose, monkeypatch):
    """Scores are those of one model that holds the counts of all training texts."""
    monkeypatch.setattr(lm_scoring, "CHUNK", 3_000)
    monkeypatch.setattr(lm_scoring, "STEP", 1_000)
    texts = {k: prose(80, k) + f" Only{k} here" for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    model, _, chunked = lm_scoring.train(docs, "doc_id", "text", lambda x: x % 3 != 0)
    trainer = lm_scoring.Trainer()
    for k, t in texts.items():
        if k % 3:
            trainer.step([t.encode()])
    whole = lm_scoring.Model([lm_scoring._cell(*lm_scoring._halves(c)) for c in trainer.counts], model.weights, model.refined)
    found = {}
    for row in chunked.collect():
        rows = lm_scoring._read(bytes(row["body"]))
        answers = [{"bucket": x["bucket"], "cells": bytes(x["cells"])} for x in row["cells"]]
        found |= dict(zip(rows.column(0).to_pylist(), lm_scoring._bits(model, rows.column(2).to_pylist(), answers), strict=True))
    assert found == {k: pytest.approx(whole.bits([t.encode()])[0]) for k, t in texts.items()}


def test_equal_segments_of_a_chunk_travel_once():
    text = bytes(random.Random(3).choices(range(97, 123), k=suffix_dedup.SEGMENT))
    data = np.frombuffer(text * 1_000, np.uint8).reshape(1_000, -1)
    order = np.arange(1_000)[::-1] // 2  # two of each id
    first, kind, least, late = suffix_dedup._least(np.ones(1_000, np.uint64), order, np.full(1_000, suffix_dedup.SEGMENT), data)
    assert len(first) == 1 and least.tolist() == [0] and np.flatnonzero(~late).tolist() == [998, 999]


def test_copies_in_and_across_chunks(spark, prose, monkeypatch):
    """A passage of many documents stays where the id is least, however documents are dealt into chunks."""
    passage = prose(60, 77)
    rows = [(k, f"{prose(20, k)} {passage} {prose(20, 500 + k)}") for k in range(120)] + [(0, passage), (None, passage), (7, passage + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = sorted(((r["doc_id"], r["n_bytes"], r["spans"]) for r in suffix_dedup.remove_repeats(docs).collect()), key=repr)
    for size in (1, 3_000):
        monkeypatch.setattr(suffix_dedup, "CHUNK", size)
        assert sorted(((r["doc_id"], r["n_bytes"], r["spans"]) for r in suffix_dedup.remove_repeats(docs).collect()), key=repr) == whole
    assert all((len(s) == 0) == (i == 0) for i, n, s in whole)


def test_weights_do_not_depend_on_the_order_of_rows():
    """The length of a step is taken from all rows, heavy ones included."""
    symbol, contexts, codes, _ = lm_scoring._keys([b"the end of the other end", b"a heavy row"])
    kinds = [lm_scoring._kinds(lm_scoring._key(symbol, c)) for c in contexts]
    times = np.where(np.arange(len(symbol)) == 5, 10_000, 1)
    found = []
    for by in (np.arange(len(symbol)), np.roll(np.arange(len(symbol)), 1)):
        trainer = lm_scoring.Trainer()
        for _ in range(2):
            trainer.learn(symbol[by], [(own, kind[by]) for own, kind in kinds], times[by])
        found.append(trainer.weights)
    assert np.allclose(*found)


def test_every_insult_is_learned(spark, prose):
    """A hundred insults, none in more than a few documents; and words longer than any window."""
    rng = random.Random(9)
    stems = ["".join(rng.choices("bcdfghjklmnpqrstvwxyzaeiou", k=9)) for _ in range(100)]
    long = "".join(rng.choices("qxzjk", k=90))
    rows = [(f"{prose(12, 17 * k + j)} {x} {prose(12, 91 * k + j)}", 1) for k, x in enumerate([*stems, long]) for j in range(8)]
    rows += [(prose(60, k), 0) for k in range(2_500)]
    model = toxicity.train(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, text string, y int"))
    around = sorted(set(prose(3_000, 8).split()))
    scores = model.score(model.worst([f"so {x} it" for x in [*stems, long]]))
    assert np.mean(scores > 0.7) > 0.95 and scores[-1] > 0.7
    assert np.mean(model.score(model.worst([f"so {x} it" for x in around])) < 0.7) > 0.97 and model.score(model.worst(["qualm", ""])).max() < 0.7


def test_a_small_task_learns_weights(spark, prose):
    """One task, less text than a full step."""
    docs = spark.createDataFrame([(k, prose(120, k)) for k in range(60)], "doc_id long, text string").coalesce(1)
    model, _, _ = lm_scoring.train(docs, "doc_id", "text", lambda x: x % 5 != 0)
    weights, _ = lm_scoring._start()
    assert np.abs(model.weights - weights).max() > 0.05
    out = {r["held_out"]: (r["s"], r["b"]) for r in lm_scoring.score(docs, lambda x: x % 5 != 0).groupBy("held_out").agg({"score": "sum", "base_score": "sum"}).toDF("held_out", "s", "b").collect()}
    assert all(s < 0 for s, _ in out.values())


def test_lm_step_takes_little_memory_and_shares_change_nothing(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(2, 9, 30_000)]
    texts = [b" ".join(words[k] for k in rng.integers(0, len(words), 500)) for _ in range(600)]
    size = sum(map(len, texts))
    tracemalloc.start()
    symbol, contexts, codes, _ = lm_scoring._keys(texts)
    keys_peak = tracemalloc.get_traced_memory()[1]
    own, kind = lm_scoring._kinds(lm_scoring._key(symbol, contexts[4]))
    table = lm_scoring._cell(own, np.ones(len(own), np.int64))
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    cells = lm_scoring._cells(table, own)
    cells_peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert keys_peak < 55 * size and cells_peak < 150 * len(own)  # bytes; 65 and 258 when a step was worked on as a whole
    assert len(cells) == lm_scoring._starts(own)[-1]
    # told apart in many shares, and in slices, all is as it was
    monkeypatch.setattr(lm_scoring, "SHARE", 5_000)
    monkeypatch.setattr(lm_scoring, "SLICE", 1_000)
    again = lm_scoring._keys(texts)
    assert (again[0] == symbol).all() and (again[2] == codes).all() and all((a == b).all() for a, b in zip(again[1], contexts, strict=True))
    for c in contexts:
        key = lm_scoring._key(symbol, c)
        sets, which = lm_scoring._kinds(key)
        assert (sets == np.unique(key)).all() and (sets[which] == key).all()
    assert (lm_scoring._cells(table, own) == cells).all() and len(lm_scoring._cells(table, own[:0])) == 0
    lists = [np.unique(rng.integers(0, 40_000, n).astype(np.uint64)) for n in (0, 30_000, 50, 20_000)]
    counts = [rng.integers(0, 9, len(x)) for x in lists]
    found = lm_scoring._totals(lists, counts)
    whole = lm_scoring._sum(np.concatenate(lists), np.concatenate(counts))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(found, whole, strict=True))
