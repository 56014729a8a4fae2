"""The stages one by one against brute force, on tables made for it, and the pipeline as a whole."""

import collections
import random

import pytest
from test_copies import brute_repeats, roots, shingle_set

import corpus_pipeline
from cborlake.llm import common

COLUMNS = list(corpus_pipeline.COLUMNS)
BAD = ["blockhead", "nincompoop", "scoundrel", "dunderhead"]


@pytest.fixture(scope="module")
def tables(spark, prose, tmp_path_factory):
    rng = random.Random(6)
    passage = prose(70, 77)
    rows, labels, toxic = [], [], set()
    for k in range(700):
        words = prose(rng.randrange(40, 90)).split()
        if k % 6 == 0:
            toxic.add(k)
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words)
        if k % 10 == 1:
            text += " " + passage
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        labels.append((k, 1, int(k in toxic)))
    for k in range(60):
        base = rows[1 + 6 * k]
        words = base[1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + k, " ".join(words) if k % 2 else base[1], "de", "s9", None))
    rows += [(2000, None, "en", None, None), (2001, "", None, "s1", 0), (None, "lonely text of no id", "en", "s1", 20), (2002, "naïve été " * 20, "fr", "s1", 180), rows[1], rows[1]]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), toxic


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_stages(spark, tables, tmp_path):
    where, toxic = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, where).write.parquet(str(tmp_path / name))
        results[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
        if name != "best_fit_packing":
            assert docs.columns == COLUMNS

    before, after = map(rows_of, results["toxicity"])
    assert not {r[0] for r in after} & toxic and len(after) >= 0.99 * sum(r[0] not in toxic for r in before) and set(after) <= set(before)

    before, after = map(rows_of, results["ngram_jaccard_join"])
    sets = [shingle_set(r[1]) for r in before]
    links = [(a, b) for a in range(len(before)) for b in range(a + 1, len(before)) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    top = roots(range(len(before)), links)
    classes = collections.defaultdict(list)
    for k, t in top.items():
        classes[t].append(before[k])
    assert after == sorted([min(c, key=lambda r: (r[0] is None, r[0])) for c in classes.values()], key=repr) and len(links) >= 50

    before, after = map(rows_of, results["suffix_dedup"])
    cut = {i: (n, gone) for i, n, gone, _, _ in brute_repeats([(r[0], (r[1] or "").encode()) for r in before])}
    assert [(r[0], *r[2:4]) for r in before] == [(r[0], *r[2:4]) for r in after]
    for old, new in zip(before, after, strict=True):
        n, gone = cut[old[0]]
        if gone:
            assert n - gone - 6 <= len(new[1].encode()) <= n - gone and new[4] == len(new[1])
        else:
            assert old == new
    assert sum(gone > 0 for _, gone in cut.values()) >= 20

    before, after = map(rows_of, results["mixing"])
    copies = collections.Counter(after)
    assert set(copies) <= set(before) and max(copies.values()) <= 3

    docs, packed = results["best_fit_packing"]
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    bins = collections.defaultdict(list)
    for r in packed.collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 1024 and sorted(b)[0][0] == 0 for b in bins.values())


def test_run(spark, tables):
    where, toxic = tables
    out = corpus_pipeline.run(spark, where).collect()
    assert len(out) > 400 and not {r["doc_id"] for r in out} & toxic


def test_empty_tables(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "none"))
    docs = spark.read.parquet(str(tmp_path / "none"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables[0]).count() == 0, name


def test_release_spares_what_is_read(spark):
    kept = common.materialize(spark.range(5).toDF("x"), "kept")
    gone = common.materialize(spark.range(5).toDF("x"), "gone")
    common.release(kept.selectExpr("x + 1 AS x"))
    assert kept.count() == 5
    with pytest.raises(Exception, match="does not exist|FileNotFound|No such file"):
        gone.count()


def test_workers_give_up_what_they_keep():
    """The encoder stays from task to task of packing, and goes when its worker does something else."""
    from cborlake.llm import packing
    from cborlake.llm.queries import tokenizer_path

    own, rows = packing.encoder(tokenizer_path()), [1, 2, 3]
    assert list(common.frugal("packing", iter)(rows)) == rows
    assert packing.encoder(tokenizer_path()) is own
    assert list(common.frugal("toxicity", iter)(rows)) == rows
    assert not common._kept
