"""What a task does grows no faster than what it is given."""

import os

import numpy as np
import pyarrow as pa

from cborlake.llm import common, lm_scoring


def _learned(prose, n):
    texts, most, trainer = [prose(200, k).encode() for k in range(n)], 0, lm_scoring.Trainer()
    for _, _, symbol, kinds, codes, _ in lm_scoring._steps(texts, trainer):
        trainer.learn(symbol, kinds, np.bincount(codes, minlength=len(symbol)))
        most = max(most, trainer.bytes)
    return trainer, most, sum(len(t) + 1 for t in texts)


def test_a_task_holds_counts_of_a_bounded_text(prose, monkeypatch):
    monkeypatch.setattr(lm_scoring, "STEP", 10_000)
    monkeypatch.setattr(lm_scoring, "LEARNED", 30_000, raising=False)
    trainer, most, size = _learned(prose, 200)
    assert size > 150_000 and most <= 40_000
    assert trainer.map[1].sum() - lm_scoring._start()[1][1].sum() > 2 * size  # several bits of each byte were learned from, in each run of counts


def test_cells_are_worked_out_once_for_each_key_of_a_bucket(prose, monkeypatch):
    symbol, contexts, codes, _ = lm_scoring._keys([prose(300, 1).encode()])
    keys, kind = lm_scoring._kinds(lm_scoring._key(symbol, contexts[3]))
    n = np.bincount(kind, np.bincount(codes), len(keys)).astype(np.int64)
    chunks = [slice(0, None), slice(0, None, 2), slice(1, None, 3)] * 5
    asked, cells = [], lm_scoring._cells
    monkeypatch.setattr(lm_scoring, "_cells", lambda table, own: asked.append(len(own)) or cells(table, own))
    bodies = [lm_scoring._planes(np.diff(keys[w], prepend=np.uint64(0))) for w in chunks]
    out = lm_scoring._answer(pa.table({"chunk": pa.array(range(len(chunks)), pa.int64()), "bucket": pa.array([0] * len(chunks), pa.int32()), "body": bodies, "count": [lm_scoring._planes(n[w].copy()) for w in chunks]}))
    assert sum(asked) == len(keys)
    total = np.zeros(len(keys), np.int64)
    for w in chunks:
        total[w] += n[w]
    for w, body in zip(chunks, out.column("cells").to_pylist(), strict=True):
        assert (lm_scoring._numbers(body, np.int16) == cells(lm_scoring._cell(keys, total), keys[w])).all()


def test_cells_follow_from_counts_of_what_shares_the_bits():
    rng = np.random.default_rng(5)
    keys = np.unique((rng.integers(0, 40, 900).astype(np.uint64) << np.uint64(9)) | rng.integers(0, 257, 900).astype(np.uint64) * (rng.random(900) < 0.7).astype(np.uint64))
    n = rng.integers(1, 5000, len(keys)) ** rng.integers(0, 3, len(keys))
    asked = np.unique(rng.integers(0, 45, 600).astype(np.uint64) << np.uint64(9) | rng.integers(0, 257, 600).astype(np.uint64))
    found, starts = lm_scoring._cells(lm_scoring._cell(keys, n), asked), lm_scoring._starts(asked)
    code = lambda key: format(lm_scoring._BITS[s := lm_scoring._ORDER[int(key) & 511]], f"0{lm_scoring._SIZES[s]}b")
    for a, at in zip(asked, starts[:-1], strict=True):
        here = [(code(k), int(x)) for k, x in zip(keys, n, strict=True) if k >> np.uint64(9) == a >> np.uint64(9)]
        for d in range(len(code(a))):
            ones, zeros = (sum(x for c, x in here if c.startswith(code(a)[:d] + bit)) for bit in "10")
            logit = np.clip(np.log((ones + lm_scoring.PRIOR) / (zeros + lm_scoring.PRIOR)), -lm_scoring.BOUND, lm_scoring.BOUND)
            assert abs((found[at + d] >> 3) - logit / lm_scoring.UNIT) < 0.51 and found[at + d] & 7 == np.searchsorted(lm_scoring.SEEN, ones + zeros, side="right")


def test_a_folder_of_a_table_goes_when_it_was_read(spark):
    own = common.materialize(spark.range(30).selectExpr("id", "int(id % 3) AS turn"), "folders", by=("turn", 3))
    path = own.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://")
    common.discard(own, "turn=1")
    assert sorted(x for x in os.listdir(path) if x.startswith("turn")) == ["turn=0", "turn=2"] and own.where("turn = 2").count() == 10
    common.discard(own)
    assert not os.path.exists(path)
