"""Mixing sources to target weights by a time-varying curriculum.

Targets: each source gets a share of all words by its weight, no more than CAP times its own words, the excess
going to the others by weight. A source's documents stand in a fixed pseudo-random order; passes over that order
are laid end to end until the target is met, so that whole documents are taken and each source ends within half
a document of its target. Each copy of a document sits at some cumulative word of its source; the source's weight
schedule, integrated over training time, says what share of its words is used by when; the demands of all sources
add up to the words used by then, and a training position is such a cumulative number of words, as a share of all. Schedules
are piecewise linear, so that both the integrals and their inverses are exact between KNOTS. Documents are then range-sorted
by position.

Defined results: null texts have size 0; documents of size 0 are never taken. A null source is a source of its own,
after all others. Null ids and repeated rows are documents of their own. Other columns are carried by ``arrange``
only. An empty table gives an empty plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, materialize, parts, quoted

WEIGHTS = (5, 2, 1)
CAP = 3
#: Schedules by weight class, as (time, weight) points from time 0 to 1, linear in between: the heavy sources are used evenly,
#: the middle ones more in the beginning, the light ones more towards the end. Only their form counts; how much of a source
#: is used is its target.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.2), (1.0, 1.8)))
#: A source's documents are summed in so many slices of its order, so that a large source is no single task.
SLICES = 1024


def sizes(docs: DataFrame, text_col: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """per_source: source, source_size. Adds w_class (place of the source among all, modulo the weights) and target.

    Water filling: sources above the cap are fixed at it and the rest share what is left by weight, until no further
    source is above. Only sums come to the driver; each round fixes a source at least and the sums are scalars.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = per_source.withColumn("w_class", (place % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("w_class") + 1))
    ranked = materialize(ranked, "sources")
    limit = cap * F.col("source_size").cast("double")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = 0.0, -1
    while True:
        # a source once fixed stays fixed, as the level only rises
        is_fixed = F.lit(False) if fixed < 0 else level * F.col("weight") > limit
        n, left, free = ranked.agg(F.sum(is_fixed.cast("long")), F.sum(F.when(is_fixed, limit).otherwise(0.0)), F.sum(F.when(is_fixed, 0.0).otherwise(F.col("weight")))).first()
        if not free or n == fixed:
            break
        fixed, level = n, (total - left) / free
    return ranked.select("source", "source_size", "w_class", F.least(limit, F.lit(level) * F.col("weight")).alias("target"))


def _knots(schedule: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float]]:
    """Of each piece of a schedule: where it begins in time, the share of the whole used before, and weight and slope of the
    weight there; weights are scaled so that the whole is 1."""
    if len(schedule) < 2 or schedule[0][0] != 0 or schedule[-1][0] != 1 or any(b <= a for (a, _), (b, _) in zip(schedule, schedule[1:], strict=False)) or any(w < 0 for _, w in schedule):
        raise ValueError(f"a schedule has rising times from 0 to 1 and no weight below 0: {schedule}")
    areas = [(b - a) * (v + w) / 2 for (a, v), (b, w) in zip(schedule, schedule[1:], strict=False)]
    whole = sum(areas)
    if not whole > 0:
        raise ValueError(f"a schedule with no weight: {schedule}")
    return [(a, sum(areas[:k]) / whole, v / whole, (w - v) / (b - a) / whole) for k, ((a, v), (b, w)) in enumerate(zip(schedule, schedule[1:], strict=False))]


def _points(schedule: tuple[tuple[float, float], ...]) -> Column:
    return F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("time", "used", "weight", "slope"), k, strict=True)]) for k in _knots(schedule)])


def used_by(time: Column, points: Column) -> Column:
    """Share of a source's words used by then: the integral of its schedule."""
    at = F.element_at(F.filter(points, lambda k: k["time"] <= time), -1)
    gone = time - at["time"]
    return at["used"] + gone * (at["weight"] + at["slope"] * gone / 2)


def demanded_at(share: Column, points: Column) -> Column:
    """Time at which this share of a source's words is used: the inverse of ``used_by``."""
    at = F.element_at(F.filter(points, lambda k: k["used"] <= share), -1)
    rest = F.greatest(F.lit(0.0), share - at["used"])
    root = F.sqrt(F.greatest(F.lit(0.0), at["weight"] * at["weight"] + 2 * at["slope"] * rest))
    # without cancellation where the slope is small
    return F.least(F.lit(1.0), at["time"] + F.when(rest <= 0, 0.0).otherwise(2 * rest / (at["weight"] + root)))


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, schedules: tuple[tuple[tuple[float, float], ...], ...] = SCHEDULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each document: id, source, size, source_size, target, copies (long), positions (array<double>, the share
    of all words taken that the mix has used when it takes the copy), and the columns ``keep`` under their own names in the struct ``kept``."""
    # rows of one id, or of none, are told apart by their texts, so that they do not all fall into one slice
    mixed = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(7))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), sizes(docs, text_col).alias("size"), mixed.alias("h"), *([F.struct(*quoted(keep)).alias("kept")] if keep else []))
    rows = rows.withColumn("slice", F.shiftrightunsigned("h", 54))
    light = materialize(rows, "sizes")
    slices = light.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = F.sum("slice_size").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    slices = slices.withColumn("before", F.coalesce(before, F.lit(0)))
    goal = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    slices = slices.alias("s").join(goal.alias("g"), F.expr("s.source <=> g.source")).select("s.source", "slice", "before", "source_size", "w_class", "target")
    within = F.sum("size").over(W.partitionBy("source", "slice").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, -1))
    d = light.withColumn("within", F.coalesce(within, F.lit(0))).alias("d")
    joined = d.join(slices.alias("s"), F.expr("d.source <=> s.source AND d.slice = s.slice")).select("d.*", "before", "source_size", "w_class", "target")
    at = F.col("before") + F.col("within")
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("full") * F.col("source_size")
    more = (F.col("full") < cap) & (at + F.col("size") / 2 <= rest)
    classes = goal.groupBy("w_class").agg(F.sum("target").alias("demand")).collect()  # a row for each weight
    whole = sum(r["demand"] for r in classes) or 1.0
    points = F.array(*[_points(schedules[k % len(schedules)]) for k in range(len(weights))])
    counted = joined.withColumn("full", full).withColumn("copies", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("full") + more.cast("long")).cast("long"))
    share = lambda e: (e * F.col("source_size") + at + F.col("size") / 2) / F.col("target")
    mixed_by = lambda t: sum((F.lit(r["demand"] / whole) * used_by(t, F.element_at(points, r["w_class"] + 1)) for r in classes), F.lit(0.0))
    time = lambda e: demanded_at(F.least(share(e), F.lit(1.0)), F.element_at(points, (F.col("w_class") + 1).cast("int")))
    # a time in an array of its own, so that it is worked out once
    place = lambda e: F.transform(F.array(time(e)), mixed_by)[0]
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), place)).otherwise(F.array().cast("array<double>"))
    out = ["source", "size", "source_size", "target", "copies"]
    return counted.select(F.col("id").alias(id_col), *out, positions.alias("positions"), *(["kept"] if keep else []))


def by_position(planned: DataFrame) -> DataFrame:
    """planned with first_position, range-sorted by it: the documents in the order of their first copies, then those of
    which none is taken."""
    rows = planned.withColumn("first_position", F.get("positions", F.lit(0)))
    order = F.col("first_position").asc_nulls_last()
    return rows.repartitionByRange(parts(planned.sparkSession), order).sortWithinPartitions(order)


def arrange(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: the columns of docs, a row for each copy taken, range-sorted by training position. Plans are made
    on ids, sources and sizes; texts are shuffled when the copies are known and when they are sorted, and not before."""
    tagged = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*quoted(docs.columns)).alias("row")), "mixed", compression="zstd")
    field = lambda c: F.col("row").getField(c)
    light = tagged.select("uid", field(id_col).alias("id"), field(source_col).alias("source"), field(text_col).alias("text"))
    planned = plan(light, "id", "source", "text", keep=("uid",), **how)
    copies = planned.select("kept.uid", F.explode("positions").alias("position"))
    taken = tagged.join(copies, "uid").select("row", "position")
    ordered = taken.repartitionByRange(parts(docs.sparkSession), "position").sortWithinPartitions("position")
    return ordered.select(*[field(c).alias(c) for c in docs.columns])
