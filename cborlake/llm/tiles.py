"""Comparison of groups in tiles.

A group (documents or vectors that may be alike) is dealt into tiles of bounded size; each unordered pair of tiles is
one row of work, so that a group of any size spreads over the cluster, and no pair of members is ever a row. What a
pair of tiles finds leaves as one row for each member that has a link: how many links, and the least member it is
tied to inside the pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_pairs(tiles: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """tiles: grp, tile, n_tiles, body. Returns left and right bodies (right null where a tile meets itself).

    allowed: pairs of groups (grp, other) to be compared besides each group with itself.
    """
    own = tiles.select("grp", "tile", F.explode(F.sequence("tile", F.col("n_tiles") - 1)).alias("with")).select("grp", "tile", F.col("grp").alias("grp2"), "with")
    if allowed is not None:
        n = tiles.groupBy("grp").agg(F.first("n_tiles").alias("n2"))
        cross = tiles.select("grp", "tile").join(allowed, "grp").join(n.withColumnRenamed("grp", "other"), "other")
        own = own.unionByName(cross.select("grp", "tile", F.col("other").alias("grp2"), F.explode(F.sequence(F.lit(0), F.col("n2") - 1)).alias("with")))
    same = F.expr("grp = grp2 AND tile = with")
    left = tiles.select("grp", "tile", F.col("body").alias("left"))
    right = tiles.select(F.col("grp").alias("grp2"), F.col("tile").alias("with"), F.col("body").alias("right"))
    alone = own.where(same).join(left, ["grp", "tile"]).select("left", F.lit(None).cast(tiles.schema["body"].dataType).alias("right"))
    pairs = own.where(~same).join(left, ["grp", "tile"]).join(right, ["grp2", "with"]).select("left", "right")
    return alone.unionByName(pairs)


def forest(hits: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """hits: left x right, or symmetric if right is None. Returns the members that have a hit and, for each, the least
    member it is connected with inside these tiles."""
    if right is None:
        ids, square = left, hits
    else:
        ids, square = np.concatenate([left, right]), None
    n, rows = len(ids), hits.shape[0]
    root = np.full(n, -1, np.int64)
    has = hits.any(1) if square is not None else np.concatenate([hits.any(1), hits.any(0)])
    for start in np.flatnonzero(has):
        if root[start] >= 0:
            continue
        seen = np.zeros(n, bool)
        seen[start] = True
        front = seen.copy()
        while front.any():
            if square is not None:
                reach = square[front].any(0)
            else:
                reach = np.zeros(n, bool)
                if front[:rows].any():
                    reach[rows:] = hits[front[:rows]].any(0)
                if front[rows:].any():
                    reach[:rows] = hits[:, front[rows:]].any(1)
            front = reach & ~seen
            seen |= front
        root[seen] = ids[seen].min()
    return ids[has], root[has]


FOUND = "node long, links long, root long"


def counted(hits: np.ndarray, left: np.ndarray, right: np.ndarray | None, left_n: np.ndarray, right_n: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """FOUND of a pair of tiles; *_n: how many equal members each stands for."""
    nodes, roots = forest(hits, left, right)
    if right is None:
        links = hits @ left_n
        links = links[hits.any(1)]
    else:
        links = np.concatenate([(hits @ right_n)[hits.any(1)], (hits.T @ left_n)[hits.any(0)]])
    yield nodes, links.astype(np.int64), roots


def summed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of FOUND rows: links of each node, and the links (a, b) that tie it to others."""
    return found.groupBy("node").agg(F.sum("links").alias("links")), found.select(F.col("node").alias("a"), F.col("root").alias("b"))
