"""n-gram Jaccard self-join with Bayesian pruning of candidates.

1. Texts become sets of five-word shingles (64-bit hashes). Texts of one set are a class, counted once.
2. Classes whose MinHash values agree in one of BANDS bands of ROWS values are in a bucket. Buckets of the same members are
   worked through once. In a bucket MinHash values are compared step by step; after each step the posterior probability
   that a pair reaches the threshold, given how many values agree and a uniform prior, is looked up, and pairs for which it
   fell below TOLERANCE are dropped. All members meet the least one first, and only those dropped there meet all others, in
   tiles, so that a bucket of copies costs no more than its size. With 24 bands of 4, a pair at the threshold itself is
   missed with a probability of 3e-6, and only if no third text ties the two.
3. Classes tied by pairs that stay are a group; chance collisions tie nothing. A group is dealt into tiles, and pairs of
   tiles compare MinHash values once more, as pairs within a group need not have met.
4. What is left is verified exactly, by intersecting the shingle sets in integers.

Defined results: texts of one to four words have all their words as one shingle; null texts and those without words
link with nothing. Null ids and repeated rows are documents of their own. Other columns are not carried. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, quoted
from .components import components
from .textvec import chunks, shingles
from .tiles import FOUND, counted, forest, summed, tile_pairs

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Similarity wanted, as a ratio of integers.
NUMERATOR, DENOMINATOR = 4, 5
TOLERANCE = 1e-7
STEP = 16
TILE, TILE_SHINGLES = 512, 1_000_000
_A = (np.random.default_rng(20).integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = np.random.default_rng(21).integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets: len(sets) x HASHES."""
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        y = x * _A[k] + _B[k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(y, begins)
    return out


@lru_cache
def least_agreeing(n: int, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, tolerance: float = TOLERANCE) -> int:
    """The least m of n agreeing values at which a pair stays. With a uniform prior the posterior is Beta(m + 1,
    n - m + 1), whose mass above t is the probability of at most m successes in n + 1 trials of chance t."""
    t = numerator / denominator
    mass = 0.0
    for m in range(n + 1):
        mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if mass >= tolerance:
            return m
    return n


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, id, digest (of the text), key (names the shingle set; null if empty), size and signature of each document,
    as a table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(3)]
            for a, b in chunks(texts):
                sets = shingles(texts[a:b])
                full = [k for k, s in enumerate(sets) if len(s)]
                sig = signatures([sets[k] for k in full]) if full else np.zeros((0, HASHES), np.uint32)
                keys: list = [None] * len(sets)
                sigs: list = [None] * len(sets)
                for k, row in zip(full, sig, strict=True):
                    keys[k], sigs[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), row.tobytes()
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:3], pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())], names=["uid", "id", "digest", "key", "size", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(frugal("ngram_join", read), f"uid long, id {kind}, digest long, key binary, size long, sig binary"), "features")


def _sets(docs: DataFrame, feats: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and shingle set of the candidates only, worked out again from their texts, which take less room in a
    shuffle than the sets of all documents would."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in shingles(texts[a:b])], pa.binary())], names=["node", "sets"])

    wanted = feats.select(F.col("uid").alias("node"), F.col("id").alias("wid"), F.col("digest").alias("wdigest")).join(groups.select("node"), "node")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    found = texts.join(wanted, F.expr("id <=> wid AND xxhash64(text) = wdigest")).select("node", "text")
    return found.mapInArrow(frugal("ngram_join", read), "node long, sets binary").dropDuplicates(["node"])  # rows that repeat give a set twice


_SIGNED = "array<struct<node:long,sig:binary>>"


def candidates(classes: DataFrame) -> DataFrame:
    """Ties (a, b) between classes that share a band and whose values agree often enough; any two that do are connected."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(ROWS)], np.uint64)
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = (sig * weights).sum(2) + salt
            key ^= key >> np.uint64(29)
            key *= np.uint64(0xBF58476D1CE4E5B9)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(key.ravel().view(np.int64))], names=["node", "band"])

    rows = classes.select("node", "sig").mapInArrow(frugal("ngram_join", bands), "node long, band long")
    rows = materialize(rows, "bands")
    buckets = rows.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all")).where("n > 1")
    # of buckets with the same members one is worked through
    buckets = buckets.groupBy("least", "n", "all").agg(F.min("band").alias("band")).select("band", "least", F.ceil(F.col("n") / TILE).cast("long").alias("n_tiles"))
    signed = classes.select("node", "sig")
    members = rows.join(materialize(buckets, "buckets"), "band").join(signed, "node")
    tiles = members.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("n_tiles"))).groupBy("band", "tile").agg(F.first("n_tiles").alias("n_tiles"), F.first("least").alias("least"), F.collect_list(F.struct("node", "sig")).alias("body"))
    led = tiles.join(signed.select(F.col("node").alias("least"), F.col("sig").alias("lead")), "least").select("band", "tile", "n_tiles", "least", "lead", "body")
    met = materialize(led.mapInArrow(frugal("ngram_join", _meet), f"band long, tile long, a array<long>, b array<long>, body {_SIGNED}, rest {_SIGNED}"), "met")
    ties = met.select(F.explode(F.arrays_zip("a", "b")).alias("t")).select("t.a", "t.b")
    # what is left of a bucket's tiles comes together, so that it meets each tile once
    alone = met.select("band", F.explode("rest").alias("r"))
    alone = alone.join(alone.groupBy("band").agg(F.ceil(F.count("*") / TILE).cast("long").alias("n")), "band")
    left = alone.groupBy("band", F.pmod(F.xxhash64("r.node"), F.col("n")).alias("part")).agg(F.collect_list("r").alias("rest"))
    pairs = left.join(met.where("body IS NOT NULL").select("band", "body"), "band").select("rest", "body")
    late = pairs.repartition(max(8, 4 * classes.sparkSession.sparkContext.defaultParallelism)).mapInArrow(frugal("ngram_join", _meet_all), "a long, b long")
    return ties.unionByName(late).where("a <> b").distinct()


def _signatures(members: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    rows = members.values
    return rows.field("node").to_numpy(), np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint32).reshape(-1, HASHES)


def _tied(a: np.ndarray, sig_a: np.ndarray, b: np.ndarray, sig_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of a and b that agree with others, each with the least one it is connected with."""
    i, j = _agree(sig_a, sig_b, False)
    hits = np.zeros((len(a), len(b)), bool)
    hits[i, j] = True
    hits &= a[:, None] != b[None, :]
    return forest(hits, a, b)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties of the members of a tile with the bucket's least one. Those that are not tied meet all others: here, if the
    bucket has one tile; otherwise they and the tile's members are handed on."""
    for batch in batches:
        n_tiles, least = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        members = batch.column(5)
        out: dict[str, list] = {"a": [], "b": []}
        rest: list[np.ndarray] = []  # places among the members of the batch
        for k in range(batch.num_rows):
            node, sig = _signatures(members[k])
            lead = np.frombuffer(batch.column(4)[k].as_py(), np.uint32)
            near = node == least[k]
            near[_agree(sig, lead[None, :], False)[0]] = True
            a, b, far = [node[near]], [np.full(near.sum(), least[k])], np.zeros(0, np.int64)
            if not near.all() and n_tiles[k] == 1:
                found, root = _tied(node[~near], sig[~near], node, sig)
                a.append(found)
                b.append(root)
            elif not near.all():
                far = members.offsets[k].as_py() + np.flatnonzero(~near)
            out["a"].append(np.concatenate(a))
            out["b"].append(np.concatenate(b))
            rest.append(far)
        ties = [pa.array(out[c], pa.list_(pa.int64())) for c in "ab"]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rest])]), pa.int32())
        left = pa.ListArray.from_arrays(ends, members.values.take(pa.array(np.concatenate([*rest, np.zeros(0, np.int64)]), pa.int64())))
        large = np.flatnonzero(np.array(n_tiles) > 1) if n_tiles else np.zeros(0, np.int64)
        body = members.take(pa.array([k if n > 1 else None for k, n in enumerate(n_tiles)], pa.int64())) if len(large) else pa.nulls(batch.num_rows, members.type)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *ties, body.cast(left.type), left], names=["band", "tile", "a", "b", "body", "rest"])


def _meet_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            a, b = _tied(*_signatures(batch.column(0)[k]), *_signatures(batch.column(1)[k]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _agree(a: np.ndarray, b: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no look at the posterior has dropped."""
    i = j = m = None
    for done in range(0, HASHES, STEP):
        least = least_agreeing(done + STEP)
        if i is None:
            total = np.zeros((len(a), len(b)), np.uint8)
            for k in range(done, done + STEP):
                total += a[:, k, None] == b[None, :, k]
            live = total >= least
            if own:
                live &= np.tri(len(a), len(a), -1, bool)
            i, j = np.nonzero(live)
            m = total[i, j].astype(np.int64)
        else:
            for k in range(done, done + STEP):
                m += a[i, k] == b[j, k]
            stay = m >= least
            i, j, m = i[stay], j[stay], m[stay]
    return i, j


def _overlap(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of x[i] and y[j]."""
    left, right = np.unique(i), np.unique(j)
    if len(i) < 4 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(x[a], y[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    parts = [x[a] for a in left] + [y[b] for b in right]
    names, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(inverse, kind="stable")
    row, inverse = row[order], inverse[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(names), 4096):  # float32 counts exactly to 16 million
        a, b = np.searchsorted(inverse, [at, at + 4096])
        grid = np.zeros((len(parts), 4096), np.float32)
        grid[row[a:b], inverse[a:b] - at] = 1
        total += grid[: len(left)] @ grid[len(left) :].T
    return total[np.searchsorted(left, i), np.searchsorted(right, j)].astype(np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            a, b = _open(batch.column(0)[k]), _open(batch.column(1)[k])
            other = b or a
            i, j = _agree(a["sig"], other["sig"], b is None)
            if not len(i):
                continue
            inter = _overlap(a["sets"], other["sets"], i, j)
            sizes, sizes2 = (np.array([len(s) for s in t["sets"]]) for t in (a, other))
            ok = DENOMINATOR * inter >= NUMERATOR * (sizes[i] + sizes2[j] - inter)
            hits = np.zeros((len(a["node"]), len(other["node"])), bool)
            hits[i[ok], j[ok]] = True
            if b is None:
                hits |= hits.T
            if hits.any():
                for found in counted(hits, a["node"], b and b["node"], a["n"], b and b["n"]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "links", "root"])


def _open(tile: pa.Scalar) -> dict | None:
    """A tile's rows: node, n, sig and sets."""
    if not tile.is_valid:
        return None
    rows = tile.values
    sets = [np.frombuffer(s, np.uint64) for s in rows.field("sets").to_pylist()]
    return {"node": rows.field("node").to_numpy(), "n": rows.field("n").to_numpy(), "sig": np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint32).reshape(-1, HASHES), "sets": sets}


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: id, n_links (other documents of similarity 0.8 or more), class_id (least id reachable by
    links) and kept (one document of each class: the one with the least id, the first by row if ids repeat)."""
    return _linked(docs, id_col, text_col).select(F.col("id").alias(id_col), "n_links", "class_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, of the documents kept. Rows are known again by id and text; of rows
    equal in both, one stays, whichever."""
    place = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    pairs = materialize(_linked(docs, id_col, text_col).groupBy("id", "digest").agg(F.bool_or("kept").alias("stays"), F.bool_and("kept").alias("all")), "pairs").where("stays")
    same = F.expr("place.id <=> pair.id AND place.digest = pair.digest")
    named = pairs.select(F.struct("id", "digest").alias("pair"), "all")
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), place.alias("place"))
    whole = rows.join(named.where("all"), same, "left_semi").select("row")
    some = rows.join(named.where("NOT all"), same, "left_semi").groupBy("place").agg(F.first("row").alias("row")).select("row")
    return whole.unionByName(some).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, id, digest, n_links, class_id and kept of each document."""
    feats = features(docs, id_col, text_col)
    classes = materialize(feats.where("key IS NOT NULL").groupBy("key").agg(F.min("uid").alias("node"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("sig").alias("sig")), "classes")
    ties = materialize(candidates(classes), "ties")
    groups = components(ties)
    group_n = materialize(classes.join(groups, "node").select("node", "key", "n", "size", "sig", F.col("component").alias("grp")), "groups")
    per = group_n.groupBy("grp").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    per = per.select("grp", F.ceil(F.greatest(F.col("m") / TILE, F.col("s") / TILE_SHINGLES)).cast("long").alias("n_tiles"))

    members = group_n.join(_sets(docs, feats, group_n, id_col, text_col), "node").join(per, "grp")
    members = members.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("n_tiles")))
    body = F.collect_list(F.struct("node", "n", "sig", "sets")).alias("body")
    tiles = materialize(members.groupBy("grp", "tile").agg(F.first("n_tiles").alias("n_tiles"), body), "tiles")
    found = materialize(tile_pairs(tiles).repartition(max(8, 4 * docs.sparkSession.sparkContext.defaultParallelism)).mapInArrow(frugal("ngram_join", _compare), FOUND), "found")
    n_links, joined = summed(found)
    linked = components(joined)
    per_class = classes.select("key", "node", "n").join(n_links, "node", "left").join(linked, "node", "left")
    per_class = per_class.select("key", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    rows = feats.select("uid", "id", "digest", "key").join(per_class, "key", "left")
    rows = materialize(rows.select("uid", "id", "digest", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "uid").alias("component")), "members")
    # a table, so that the join below is free to split a large class
    heads = materialize(rows.groupBy("component").agg(F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull(), "id", "uid"))["uid"].alias("head")), "heads")
    return rows.join(heads, "component").select("uid", "id", "digest", "n_links", "class_id", (F.col("uid") == F.col("head")).alias("kept"))
