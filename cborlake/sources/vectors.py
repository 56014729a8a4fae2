"""Reading of vectors, lines and raw items; writing of lines, reports and dashboards."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODE_VECTOR = "id string, rule string, rationale string, source_file string, logical_value string, expected_hex string"
REJECT_VECTOR = "id string, rule string, rationale string, input_hex string, expected_verdict string, expected_reason string"
#: Characters after which a file of vectors ends.
FILE_CHARS = 8_000_000


def read_text(spark: SparkSession, path: str) -> str:
    """A small configuration file, by Spark's own reader, so that it may lie in any store."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def read_implementations(spark: SparkSession, path: str) -> DataFrame:
    """name, binary and profiles of registered implementations, from a JSON array."""
    return spark.read.schema("name string, binary string, profiles array<string>").option("multiLine", True).json(path)


def _objects(text: str, names: list[str]) -> list[list[str | None]]:
    """Of each object of a JSON array (or the one object) these members: the text of what is no string as it stands."""
    decode, blank, out = json.JSONDecoder().raw_decode, re.compile(r"[ \t\r\n]*"), []
    skip = lambda at: blank.match(text, at).end()
    at = skip(0)
    many = text[at] == "["
    at = skip(at + 1) if many else at
    while text[at] != "]" or not many:
        own: dict[str, str | None] = {}
        value, end = decode(text, at)
        if isinstance(value, dict):
            at = skip(at + 1)
            while text[at] != "}":
                name, at = json.decoder.scanstring(text, at + 1)
                begin = skip(skip(at) + 1)
                value, at = decode(text, begin)
                own[name] = value.encode("utf-8", "replace").decode() if isinstance(value, str) else None if value is None else text[begin:at]
                at = skip(at)
                at = skip(at + 1) if text[at] == "," else at
        out.append([own.get(n) for n in names])
        at = skip(end)
        if not many:
            break
        at = skip(at + 1) if text[at] == "," else at
    return out


def _arrays(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of files that hold a JSON array (or object) each; a file that is no JSON is a row of nulls. A file is read once: the reader
    of multi-line JSON goes back to it for the exact text of each nested value, by some 10 kB each time."""
    names = [x.split()[0] for x in schema.split(",")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                try:
                    rows = _objects(text.as_py(), names)
                except (ValueError, IndexError, RecursionError):
                    rows = [[None] * len(names)]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 10_000]], pa.string()) for k in range(len(names))], names=names)

    return spark.read.text(paths, wholetext=True).where(F.trim("value") != "").mapInArrow(parse, schema)


def read_vectors(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Encode vectors from files that hold a JSON array each; logical_value keeps its JSON text."""
    return _arrays(spark, paths, ENCODE_VECTOR)


def read_rejects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _arrays(spark, paths, REJECT_VECTOR)


def read_value_lines(spark: SparkSession, path: str) -> DataFrame:
    """logical_value: one JSON text for each line that is not blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("logical_value"))


def read_hex_lines(spark: SparkSession, path: str) -> DataFrame:
    """input_hex and item (null where a line is no lowercase hexadecimal of whole bytes)."""
    text = F.trim("value")
    lines = spark.read.text(path).where(text != "").select(text.alias("input_hex"))
    return lines.withColumn("item", F.unhex(F.when(F.col("input_hex").rlike("^([0-9a-f]{2})*$"), F.col("input_hex"))))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """name and item: a row for each file of a folder."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("item"))


def decode_vectors(vectors: DataFrame, rejects: DataFrame) -> DataFrame:
    """id, rule, input_hex and expected_line: what an encoder has to give must be accepted as it stands; generated
    vectors are left out, as they may carry tags that a strict decoder does not know."""
    accept = vectors.where("rule <> 'fuzz-generated'").select("id", "rule", F.col("expected_hex").alias("input_hex"), F.concat(F.lit("ACCEPT "), "expected_hex").alias("expected_line"))
    reject = rejects.select("id", "rule", "input_hex", F.concat(F.lit("REJECT "), "expected_reason").alias("expected_line"))
    return accept.unionByName(reject)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One line for each row."""
    df.select(F.coalesce(F.col(column), F.lit(""))).write.text(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.json(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Files that hold a JSON array each, with logical_value (JSON text) as a nested value: what ``read_vectors`` reads.
    A file is read by one task, so an array ends once it has FILE_CHARS characters, and the next one gets a file of its own."""
    others = F.to_json(F.struct(*["`" + c.replace("`", "``") + "`" for c in vectors.columns if c != "logical_value"]))
    value = F.col("logical_value") if "logical_value" in vectors.columns else F.lit(None).cast("string")
    nested = F.concat(F.lit('{"logical_value":'), value, F.when(others == "{}", "}").otherwise(F.concat(F.lit(","), F.substr(others, F.lit(2)))))
    most = FILE_CHARS

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(["[" + "\n,".join(held) + "\n]"])], names=["value"])

        for batch in batches:
            for text in batch.column(0):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= most:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    vectors.select(F.coalesce(nested, others).alias("value")).mapInArrow(arrays, "value string").write.option("maxRecordsPerFile", 1).text(path)


def render_dashboard(overall: list, by_rule: list) -> str:
    """Markdown of two small aggregates: rows (adapter, profile, mode, total, passed) and (rule, adapter, total, passed)."""
    rate = lambda total, passed: "n/a" if not total else f"{passed}/{total} ({100 * passed / total:.0f}%)"
    slots = sorted({(r["profile"], r["mode"]) for r in overall})
    out = ["# Conformance", "", "| adapter | " + " | ".join(f"{p} {m}" for p, m in slots) + " | overall |", "|" + "---|" * (len(slots) + 2)]
    for adapter in sorted({r["adapter"] for r in overall}):
        own = {(r["profile"], r["mode"]): r for r in overall if r["adapter"] == adapter}
        cells = [rate(own[s]["total"], own[s]["passed"]) if s in own else "n/a" for s in slots]
        out.append(f"| {adapter} | " + " | ".join([*cells, rate(sum(r["total"] for r in own.values()), sum(r["passed"] for r in own.values()))]) + " |")
    names = sorted({r["adapter"] for r in by_rule})
    out += ["", "| rule | " + " | ".join(names) + " |", "|" + "---|" * (len(names) + 1)]
    for rule in sorted({r["rule"] for r in by_rule}):
        own = {r["adapter"]: r for r in by_rule if r["rule"] == rule}
        out.append(f"| {rule} | " + " | ".join(rate(own[n]["total"], own[n]["passed"]) if n in own else "n/a" for n in names) + " |")
    return "\n".join(out) + "\n"
