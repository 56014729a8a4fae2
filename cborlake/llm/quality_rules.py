"""Rule bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for each
failed rule; policies are versioned masks over those bits, so that a new policy, or an ablation of one rule,
needs integer operations on the ledger and no second look at a text. Built-in expressions only.

Defined results: a null or empty text has zero words and fails ``few_words``. Null ids and repeated rows stay,
one ledger row for each input row. Other input columns are not carried, whatever their names. An empty table
gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

GRAM = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_distinct_words", "n_upper")


@dataclass(frozen=True)
class Rule:
    """failed: of the measurement columns, in integers so that every engine agrees on the borders."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_passages", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule(4, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(5, "shouting", "10 * n_upper > 4 * word_chars"),
    Rule(6, "few_distinct_words", "20 * n_distinct_words < n_words"),
)

#: Versioned policies: a document is rejected if one of the policy's bits is set.
POLICIES = {"base": 0b0000011, "2026.1": 0b0011111, "2026.2": 0b1111111}
POLICY = "2026.2"


def _twice(marked: Column) -> Column:
    """Sorted positions of the windows that have an equal neighbour in marked, the sorted (hash, position) pairs.
    marked has to be a column of its own: inside a function it would be worked out anew for each element."""
    equal = lambda x, k: F.coalesce(F.get(marked, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(marked, k + 1)["h"] == x["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(marked, equal), lambda x: x["i"]))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and MEASURES (long), a row for each document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    first = base.select(
        "id", "w",
        F.size("w").alias("n"),
        F.char_length(F.array_join("w", "")).alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
    )
    hashed = first.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).drop("w")
    windows = F.when(
        F.col("n") >= GRAM,
        F.transform(F.sequence(F.lit(0), F.col("n") - GRAM), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(GRAM)])),
    )
    second = hashed.withColumn("windows", windows).withColumn("n_distinct_words", F.size(F.array_distinct("h"))).drop("h")
    marked = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    third = second.withColumn("marked", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), marked)).drop("windows")
    third = third.withColumn("at", _twice(F.col("marked"))).drop("marked")
    m = F.size("at")
    # each repeated window covers words up to the next one's start, GRAM at most
    gaps = F.zip_with(F.slice("at", 2, m - 1), F.slice("at", 1, m - 1), lambda b, a: F.least(b - a, F.lit(GRAM)))
    covered = F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(GRAM), lambda s, x: s + x))
    return third.withColumn("n_repeat_words", covered).select(F.col("id").alias(id_col), *[F.col("n" if c == "n_words" else c).cast("long").alias(c) for c in MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id, MEASURES and failed_bits (long): bit b is set if the rule of that bit failed."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, id_col, text_col).withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, version: str = POLICY) -> DataFrame:
    """Adds kept (boolean) and policy (string) to a ledger."""
    mask = F.lit(POLICIES[version]).cast("long")
    return rows.withColumns({"kept": F.col("failed_bits").bitwiseAND(mask) == 0, "policy": F.lit(version)})


def ablations(rows: DataFrame, version: str = POLICY, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: failed (documents that fail it), only (documents that no other rule of the
    policy rejects, which an ablation of this rule would keep) and the bits ever seen together with it.
    The documents shrink to one row for each distinct bit pattern first."""
    mask = POLICIES[version]
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    own = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if mask >> r.bit & 1])).alias("r")
    return (
        patterns.select("bits", "n", own)
        .where(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum("n").alias("failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only"), F.bit_or("bits").alias("seen_with"))
    )
