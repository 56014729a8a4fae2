"""Embedding near-duplicates by PCA-ordered, tiled comparison.

Equal vectors shrink to one with a count. Unit vectors are turned into the axes of their second moments, largest
first (an orthonormal turn keeps every cosine). A tree over the leading axes deals them into leaves, leaves into
tiles; leaves whose boxes lie farther apart than two vectors of the wanted cosine can are never met. A pair of
tiles adds up products over the leading axes first; what the remaining axes can add is bounded by the product of
the suffix norms, and pairs that cannot reach the threshold any more leave. The rest are decided by the full
product in double precision, those within rounding of the threshold by the plain sum over the given components.
Tiles go to work in blocks, each pair of blocks that has leaves to be compared being one group of tiles, and as many
pairs of blocks at a time as take about the room of the tiles themselves: the shuffle files of a round go with it, so
that the disk needed grows with the vectors and not with the pairs of tiles.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose id is null,
links with nothing and stands alone. Vectors of different lengths do not link. Rows with equal ids count as vectors
of their own. Other columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components
from .tiles import FOUND, counted, summed

THRESHOLD = 0.9
#: Vectors of a tile, and rows of a tile compared at once.
TILE, STRIP = 4096, 512
#: The tree has as many leaves as there are tiles to fill, LEAVES at most. It is laid on PER_LEAF vectors a leaf, chosen by the
#: hash of their ids, that fit in TREE_BYTES. Any tree gives the same links; a good one saves work.
LEAVES, PER_LEAF, TREE_BYTES = 4096, 32, 64 << 20
#: Bytes of a block of tiles, one tile at least, and the least that is sent in a round; a round sends the bytes of all tiles or so.
BLOCK_BYTES, ROUND_BYTES = 16 << 20, 256 << 20
#: Leading axes added up before each look at the bound.
STEPS = (8, 24)
EPS = 1e-9


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(body: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(body)) as found:
        return {k: found[k] for k in found.files}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """Second moments of all unit vectors; each task gives dim rows, which are summed before they come here."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                u = _unit(_matrix(batch.column(0), dim))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total))], names=["axis", "row"])

    def together(group: pa.Table) -> pa.Table:
        return pa.table({"axis": group.column("axis").slice(0, 1), "row": pa.array([_rows(group.column("row"), dim).sum(0)])})

    rows = vectors.select("v").mapInArrow(add, "axis int, row array<double>").groupBy("axis").applyInArrow(together, "axis int, row array<double>")
    out = np.zeros((dim, dim))
    for r in rows.collect():  # dim rows
        out[r["axis"]] = r["row"]
    return out


def _rows(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return _matrix(column.combine_chunks(), dim)


def _tree(y: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Splits (axis, value) of a complete binary tree, in heap order; axis -1 ends a branch."""
    depth = max(0, min(int(np.log2(max(1, leaves))), int(np.log2(max(1, len(y) / PER_LEAF)))))
    nodes: list[tuple[int, float]] = []
    level = [y]
    for _ in range(depth):
        below = []
        for part in level:
            if len(part) < 2:
                nodes.append((0, np.inf))
                below += [part, part[:0]]
                continue
            axis = int(np.argmax(part.var(0)))
            cut = float(np.median(part[:, axis]))
            nodes.append((axis, cut))
            below += [part[part[:, axis] <= cut], part[part[:, axis] > cut]]
        level = below
    return nodes


def _leaf(y: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(y), np.int64)
    if nodes:
        axes, cuts = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        rows = np.arange(len(y))
        for _ in range(int(np.log2(len(nodes) + 1))):
            at = 2 * at + 1 + (y[rows, axes[at]] > cuts[at])
    return at


def _near(low: np.ndarray, high: np.ndarray, threshold: float) -> np.ndarray:
    """Which leaves' boxes are no farther apart than two unit vectors of that cosine."""
    out = np.zeros((len(low), len(low)), bool)
    for i in range(len(low)):
        gap = np.maximum(0, np.maximum(low[i] - high, low - high[i]))
        out[i] = (gap * gap).sum(1) <= 2 - 2 * threshold + EPS
    return out


def _units(leaf: np.ndarray, near: np.ndarray, block: int) -> Iterator[list[tuple[int, list[int]]]]:
    """Groups of tiles to be sent together, (tile, places in the group that it meets): one for each two blocks of tiles that
    have any to compare. leaf: of each tile, in the order of tiles; near: of leaves. Every two tiles of near leaves meet once."""
    starts = np.arange(0, len(leaf), block)
    for a in starts:
        left = np.arange(a, min(a + block, len(leaf)))
        any_near = near[np.unique(leaf[left])].any(0)[leaf]
        for b in starts[(starts >= a) & np.logical_or.reduceat(any_near, starts)]:
            right = np.arange(b, min(b + block, len(leaf)))
            meet = near[np.ix_(leaf[left], leaf[right])]
            if a == b:
                yield [(int(t), [int(j) for j in np.flatnonzero(meet[k]) if j >= k]) for k, t in enumerate(left)]
            elif meet.any():
                i, j = np.flatnonzero(meet.any(1)), np.flatnonzero(meet.any(0))
                group = [(int(left[k]), [len(i) + int(x) for x in np.flatnonzero(meet[k][j])]) for k in i]
                yield group + [(int(right[k]), []) for k in j]


def _rounds(units: Iterator[list[tuple[int, list[int]]]], most: int) -> Iterator[list[tuple[int, int, int, list[int]]]]:
    """Rows (unit, place, tile, meets) of as many units as hold that many tiles; one unit at least."""
    rows: list[tuple[int, int, int, list[int]]] = []
    for unit, group in enumerate(units):
        if rows and len(rows) + len(group) > most:
            yield rows
            rows = []
        rows += [(unit, place, tile, meets) for place, (tile, meets) in enumerate(group)]
    if rows:
        yield rows


def _hits(a: np.ndarray, b: np.ndarray | None, turn: np.ndarray, threshold: float) -> np.ndarray:
    """Which vectors of a are linked with which of b (of a, if b is None; none with itself)."""
    ua = _unit(a.astype(np.float64))
    ub = ua if b is None else _unit(b.astype(np.float64))
    ya, yb = ua @ turn, ub @ turn
    out = np.zeros((len(ua), len(ub)), bool)
    for at in range(0, len(ua), STRIP):
        k = slice(at, at + STRIP)
        i, j, cosine = _reach(ya[k], yb, at if b is None else None, threshold)
        ok = _decided(cosine, ua[k], ub, i, j, threshold)
        out[at + i[ok], j[ok]] = True
    return out


def _reach(ya: np.ndarray, yb: np.ndarray, own: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that reach the threshold, all but for rounding, and their cosines. own: where ya lies in yb."""
    dim, done, total = ya.shape[1], 0, np.zeros((len(ya), len(yb)))
    rows, cols = np.arange(len(ya)), np.arange(len(yb))
    for upto in [*(s for s in STEPS if s < dim), dim]:
        total += ya[rows, done:upto] @ yb[cols, done:upto].T
        done = upto
        rest_a, rest_b = (np.sqrt(np.maximum(0, 1 - (y[k, :done] ** 2).sum(1))) for y, k in ((ya, rows), (yb, cols)))
        bound = total + rest_a[:, None] * rest_b[None, :] if done < dim else total
        live = bound >= threshold - EPS
        if own is not None:
            live &= cols[None, :] != rows[:, None] + own
        if done == dim or live.sum() < 0.05 * live.size:
            break
        keep_r, keep_c = live.any(1), live.any(0)
        total, rows, cols = total[np.ix_(keep_r, keep_c)], rows[keep_r], cols[keep_c]
    i, j = np.nonzero(live)
    cosine = total[i, j]
    if done < dim:  # few pairs are left: the rest of their products alone
        for at in range(0, len(i), 100_000):
            k = slice(at, at + 100_000)
            cosine[k] += np.einsum("ij,ij->i", ya[rows[i[k]], done:], yb[cols[j[k]], done:])
    ok = cosine >= threshold - EPS
    return rows[i[ok]], cols[j[ok]], cosine[ok]


def _decided(cosine: np.ndarray, ua: np.ndarray, ub: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    close = np.flatnonzero(np.abs(cosine - threshold) < EPS)
    cosine[close] = (ua[i[close]] * ub[j[close]]).sum(1)
    return cosine >= threshold


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """For each row: id, n_links, component_id (least id reachable by links) and kept (id = component_id)."""
    v = F.col(vector_col)
    odd = v.isNull() | F.col(id_col).isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(~F.coalesce(odd, F.lit(True)), v).alias("v"))
    digest = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    # vectors travel here and to their tiles; all else is done by 128 bits of hash
    same = rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    classes = materialize(same.select(F.monotonically_increasing_id().alias("node"), "n", "v", digest.alias("digest")), "classes")
    rows = rows.select("id", F.when(F.col("v").isNotNull(), digest).alias("digest"))
    member = rows.where("digest IS NOT NULL").join(classes.select("digest", "node", "n"), "digest").select("id", "node", "n")
    member = materialize(member, "named")
    found: list[DataFrame] = []
    dims = sorted(r[0] for r in classes.select(F.size("v")).distinct().collect())
    for dim in dims:
        found += _links(classes.where(F.size("v") == dim), dim, threshold, classes if dim == dims[-1] else None)
    alone = rows.where("digest IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not dims:
        out = alone
    else:
        links, ties = summed(reduce(DataFrame.unionByName, found))
        member = materialize(member.join(components(ties), "node", "left").withColumn("component", F.coalesce("component", "node")).join(links, "node", "left"), "members")
        least = member.groupBy("component").agg(F.min("id").alias("component_id"))
        linked = member.join(least, "component").select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
        out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(classes: DataFrame, dim: int, threshold: float, done: DataFrame | None) -> list[DataFrame]:
    """Tables of FOUND, one for each round. done: a table that goes as soon as its vectors are in tiles."""
    turn = np.linalg.eigh(_moments(classes, dim))[1][:, ::-1].copy()
    n_leaves = min(LEAVES, -(-classes.count() // TILE))
    some = classes.select("v").orderBy(F.xxhash64("node")).limit(max(1, min(PER_LEAF * n_leaves, TREE_BYTES // (8 * dim)))).toArrow()
    nodes = _tree(_unit(_matrix(some.column(0).combine_chunks(), dim)) @ turn, n_leaves) if some.num_rows else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _unit(_matrix(batch.column(0), dim)) @ turn if batch.num_rows else np.zeros((0, dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_leaf(y, nodes)), pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), dim).cast(pa.list_(pa.float64()))], names=["v", "node", "n", "grp", "y"])

    v_type = classes.schema["v"].dataType.simpleString()
    dealt = classes.select("v", "node", "n").mapInArrow(deal, f"v {v_type}, node long, n long, grp long, y array<double>")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}  # LEAVES at most
        for batch in batches:
            y, grp = _matrix(batch.column(1), dim), batch.column(0).to_numpy()
            for g in np.unique(grp):
                own = y[grp == g]
                low, high, n = seen.get(g, (np.inf, -np.inf, 0))
                seen[g] = [np.minimum(low, own.min(0)), np.maximum(high, own.max(0)), n + len(own)]
        yield pa.RecordBatch.from_arrays([pa.array([int(g) for g in seen], pa.int64()), pa.array([list(s[0]) for s in seen.values()], pa.list_(pa.float64())), pa.array([list(s[1]) for s in seen.values()], pa.list_(pa.float64())), pa.array([s[2] for s in seen.values()], pa.int64())], names=["grp", "low", "high", "n"])

    parts = dealt.select("grp", "y").mapInArrow(bounds, "grp long, low array<double>, high array<double>, n long")

    def box(group: pa.Table) -> pa.Table:
        low, high = _rows(group.column("low"), dim).min(0), _rows(group.column("high"), dim).max(0)
        return pa.table({"grp": group.column("grp").slice(0, 1), "low": pa.array([low]), "high": pa.array([high]), "n": pa.array([sum(group.column("n").to_pylist())], pa.int64())})

    kind = "grp long, low array<double>, high array<double>, n long"
    boxes = {r["grp"]: [np.array(r["low"]), np.array(r["high"]), r["n"]] for r in parts.groupBy("grp").applyInArrow(box, kind).collect()}  # LEAVES rows
    spark = classes.sparkSession
    leaves = sorted(boxes)
    n_tiles = [max(1, -(-boxes[g][2] // TILE)) for g in leaves]
    near = _near(*(np.array([boxes[g][k] for g in leaves]) for k in (0, 1)), threshold)
    counts = F.broadcast(spark.createDataFrame([(g, n, first) for g, n, first in zip(leaves, n_tiles, (np.cumsum(n_tiles) - n_tiles).tolist(), strict=True)], "grp long, n_tiles long, first long"))  # LEAVES rows
    placed = dealt.select("v", "node", "n", "grp").join(counts, "grp").withColumn("tile", F.col("first") + F.pmod(F.xxhash64("node"), F.col("n_tiles")))
    packed = placed.groupBy("tile").agg(F.collect_list(F.struct("node", "n", "v")).alias("rows"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for k in range(batch.num_rows):
                rows = batch.column(1).slice(k, 1).flatten()
                bodies.append(_dump(node=rows.field(0).to_numpy(), n=rows.field(1).to_numpy(), v=rows.field(2).flatten().to_numpy().reshape(-1, dim)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["tile", "body"])

    tiles = materialize(packed.mapInArrow(pack, "tile long, body binary"), "tiles")
    if done is not None:
        discard(done)

    def compare(group: pa.Table) -> pa.Table:
        place = group.column("place").to_numpy()
        body, meets = group.column("body"), group.column("meets").to_pylist()
        at = {int(p): k for k, p in enumerate(place)}
        opened = {p: _load(body[k].as_py()) for p, k in at.items()}
        parts = [pa.table({c: pa.array([], pa.int64()) for c in ("node", "links", "root")})]
        for p, k in at.items():
            for q in meets[k]:
                a, b = opened.get(p), opened.get(q) if q != p else None
                if a is None or (q != p and b is None):  # a tile that no vector fell into
                    continue
                hits = _hits(a["v"], b and b["v"], turn, threshold)
                if hits.any():
                    parts += [pa.table(dict(zip(("node", "links", "root"), x, strict=True))) for x in counted(hits, a["node"], b and b["node"], a["n"], b and b["n"])]
        summed_up = pa.concat_tables(parts).group_by(["node", "root"]).aggregate([("links", "sum")])
        return summed_up.select(["node", "links_sum", "root"]).rename_columns(["node", "links", "root"])

    tile_bytes = TILE * dim * (4 if "float" in v_type else 8)
    block = max(1, min(BLOCK_BYTES // tile_bytes, sum(n_tiles) // (2 * spark.sparkContext.defaultParallelism)))
    found = []
    for rows in _rounds(_units(np.repeat(np.arange(len(near)), n_tiles), near, block), max(sum(n_tiles), ROUND_BYTES // tile_bytes)):
        sent = F.broadcast(spark.createDataFrame(rows, "unit long, place long, tile long, meets array<long>"))  # as many rows as a round has tiles
        found.append(materialize(tiles.join(sent, "tile").select("unit", "place", "meets", "body").groupBy("unit").applyInArrow(compare, FOUND), "found"))
    discard(tiles)
    return found
