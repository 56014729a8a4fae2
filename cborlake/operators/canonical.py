"""Analytics on canonical bytes: duplicates, joins and classes that ignore how a value was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.typed import canonical_hash


def dedup(rows: DataFrame, item: Column, *order: str) -> DataFrame:
    """For each distinct item: its hash, how many rows have it and the least of the order columns. Only hashes and the
    order columns are shuffled, summed up before."""
    keyed = rows.select(canonical_hash(item).alias("hash"), *order)
    return keyed.groupBy("hash").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in order])


def join(left: DataFrame, right: DataFrame, left_item: Column, right_item: Column, how: str = "inner") -> DataFrame:
    """Rows whose items are equal, met by hash."""
    return left.withColumn("hash", canonical_hash(left_item)).join(right.withColumn("hash", canonical_hash(right_item)), "hash", how)


def divergence(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """Rows whose encodings differ, as first_hex and second_hex."""
    both = rows.withColumns({"first_hex": F.lower(F.hex(first)), "second_hex": F.lower(F.hex(second))})
    return both.where(~F.col("first_hex").eqNullSafe(F.col("second_hex")))


def key_order(entries: DataFrame, item: str = "item_id", pos: str = "pos", key: str = "k") -> DataFrame:
    """Verdict of neighbouring keys for each entry after the first: DUPLICATE_KEY, UNSORTED_MAP_KEYS or OK."""
    from pyspark.sql import Window as W

    before = F.lag(key).over(W.partitionBy(item).orderBy(pos))
    verdict = F.when(F.col("before") == F.col(key), "DUPLICATE_KEY").when(F.col("before") > F.col(key), "UNSORTED_MAP_KEYS").otherwise("OK")
    return entries.withColumn("before", before).where("before IS NOT NULL").withColumn("verdict", verdict).drop("before")
