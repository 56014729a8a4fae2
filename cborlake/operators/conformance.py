"""Comparison of expected with actual results, and reports by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("adapter", "profile", "mode")


def compare(expected: DataFrame, actual: DataFrame, by: str = "id", want: str = "expected", got: str = "actual") -> DataFrame:
    """expected with ``actual`` and ``passed``; a missing result is the empty string, and fails. Rows meet by id, so
    that a result left out shifts no other."""
    rows = expected.join(actual.select(by, F.col(got).alias("actual")), by, "left")
    return rows.withColumn("actual", F.coalesce("actual", F.lit(""))).withColumn("passed", F.col("actual").eqNullSafe(F.col(want)))


def cross(vectors: DataFrame, implementations: DataFrame, profile: str) -> DataFrame:
    """Each vector with each implementation that is registered for the profile."""
    some = implementations.where(F.array_contains("profiles", profile)).select(F.col("name").alias("adapter"))
    return vectors.crossJoin(some).withColumn("profile", F.lit(profile))


def report(results: DataFrame, keys: tuple[str, ...] = KEYS, position: str = "id") -> DataFrame:
    """By keys and rule: total, passed, and the ids that failed, in order of position."""
    failed = F.transform(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct(F.col(position).alias("p"), F.col("id").alias("id"))))), lambda x: x["id"])
    return results.groupBy(*keys, "rule").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), failed.alias("failed_ids"))


def overall(report_rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Totals by every prefix of keys (null: all), and how many percent passed, as text (n/a for none)."""
    sums = report_rows.rollup(*keys).agg(F.sum("total").alias("total"), F.sum("passed").alias("passed"))
    share = F.format_string("%.0f", F.try_divide(F.lit(100.0) * F.col("passed"), F.col("total")))
    return sums.withColumn("pass_rate", F.when(F.col("total") > 0, share).otherwise(F.lit("n/a")))


def pivot(report_rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A row for each rule, a column for each value: passed of total as text, n/a where there is none."""
    cell = F.concat(F.sum("passed").cast("string"), F.lit("/"), F.sum("total").cast("string"))
    wide = report_rows.groupBy("rule").pivot(column, values).agg(cell)
    return wide.na.fill("n/a", subset=values)


def merge(*reports: DataFrame) -> DataFrame:
    """One report of several; of reports for the same keys the last one counts."""
    from pyspark.sql import Window as W

    out = None
    for k, one in enumerate(reports):
        one = one.withColumn("_turn", F.lit(k))
        out = one if out is None else out.unionByName(one)
    latest = F.max("_turn").over(W.partitionBy(*KEYS))
    return out.withColumn("_latest", latest).where("_turn = _latest").drop("_turn", "_latest")


def all_passed(results: DataFrame) -> bool:
    """The gate: false if a row failed."""
    return not results.agg(F.bool_or(~F.col("passed"))).first()[0]


def mismatches(results: DataFrame, limit: int = 20) -> DataFrame:
    """The first rows that failed, by id."""
    return results.where("NOT passed").orderBy("id").limit(limit)
