"""Strict validation of streams: stateless verdicts, windowed counts of rejections, and duplicates by canonical hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dynamic import decode_strict
from ..plans.typed import canonical_hash


def validate(stream: DataFrame, item: str, profile: str) -> DataFrame:
    """stream with verdict, reason and canonical."""
    return stream.withColumn("_d", decode_strict(F.col(item), profile)).select(*stream.columns, "_d.verdict", "_d.reason", "_d.canonical")


def reject_counts(validated: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Verdicts and reasons counted by tumbling window; state is dropped once the watermark has passed."""
    return validated.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "verdict", "reason").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "verdict", "reason", "n")


def distinct_items(stream: DataFrame, item: str, time: str, late: str = "10 minutes") -> DataFrame:
    """The first of equal items within the watermark."""
    return stream.withColumn("hash", canonical_hash(F.col(item))).withWatermark(time, late).dropDuplicatesWithinWatermark(["hash"])
