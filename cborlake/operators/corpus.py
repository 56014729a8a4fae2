"""Making of a test corpus: first of its kind, agreed by an oracle, capped with a preference, numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def prefer_first(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """Of rows equal in key the first one by order."""
    place = F.row_number().over(W.partitionBy("_key").orderBy(*order))
    return rows.withColumn("_key", key).withColumn("_place", place).where("_place = 1").drop("_key", "_place")


def agreed(candidates: DataFrame, oracle: DataFrame, by: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows whose ``actual_hex`` equals the oracle's ``oracle_hex``, and those where both exist and differ. What the oracle
    refuses, or the implementation leaves empty, is in neither."""
    both = candidates.join(oracle, by).where("oracle_hex IS NOT NULL AND coalesce(actual_hex, '') <> ''")
    return both.where("actual_hex = oracle_hex"), both.where("actual_hex <> oracle_hex")


def capped(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows by order: a top-k without a full sort."""
    return rows.orderBy(*order).limit(limit)


def numbered(rows: DataFrame, prefix: str, *order: Column) -> DataFrame:
    """rows with an id of the prefix and a five-digit number from 0; for rows that are capped."""
    return rows.withColumn("id", F.format_string(prefix + "-%05d", F.row_number().over(W.orderBy(*order)) - 1))


def stage_counts(**stages: DataFrame) -> DataFrame:
    """stage and n of each."""
    out = None
    for name, df in stages.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out
