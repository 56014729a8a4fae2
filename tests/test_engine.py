"""Columns against the plain codec, conformance analytics, sources and sinks, streams, the line protocol."""

import io
import json
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cborlake import __main__ as cli
from cborlake.functions import codec, dynamic
from cborlake.functions import columns as C
from cborlake.operators import canonical, conformance, corpus, generate, registry
from cborlake.plans import typed
from cborlake.sources import vectors
from cborlake.streaming import validate


def test_every_half_float_column(spark):
    raw = np.arange(1 << 16, dtype=np.uint16)
    rows = [(int(b), float(x)) for b, x in zip(raw, raw.view(np.float16), strict=True)]
    got = spark.createDataFrame(rows, "b int, x double").select("b", C.encode_float(F.col("x")).alias("i"), C.encode_float(F.col("x"), "f16").alias("h"), C.encode_float_dcbor(F.col("x")).alias("d")).collect()
    assert len(got) == 1 << 16
    for (b, x), r in zip(sorted(rows), sorted(got, key=lambda r: r["b"]), strict=True):
        assert bytes(r["i"]) == bytes(r["h"]) == codec.floating(x), b
        assert bytes(r["d"]) == codec.encode({"type": "float", "width": "auto", "value": repr(x) if x == x and abs(x) != float("inf") else {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(x)]}, "dcbor")


def test_floats_of_all_sizes(spark):
    rng = np.random.default_rng(3)
    xs = [float(x) for x in rng.integers(0, 1 << 63, 3000, dtype=np.int64).view(np.float64)] + [float(np.float32(x)) for x in rng.integers(0, 1 << 32, 3000, dtype=np.uint32).view(np.float32)]
    xs += [2.0**k for k in range(-1074, 1024, 7)] + [-(2.0**63), 2.0**64, 2.0**63, -(2.0**64), 1e18 + 1, 12345678901234567890.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", C.encode_float(F.col("x")).alias("i"), C.encode_float(F.col("x"), "f32").alias("s"), C.encode_float_dcbor(F.col("x")).alias("d")).collect()
    for r in got:
        x = r["x"]
        assert bytes(r["i"]) == codec.floating(x)
        single = codec._packed(x, ">f") if x == x else None
        assert x != x or (r["s"] and bytes(r["s"])) == (single and b"\xfa" + single)
        assert bytes(r["d"]) == (codec.integer(int(x)) if codec.reducible(x) else codec.floating(x))


def test_typed_equals_dynamic(spark):
    schema = T.StructType([T.StructField("b", T.StructType([T.StructField("z", T.IntegerType()), T.StructField("aa", T.BooleanType())])), T.StructField("a", T.ArrayType(T.LongType())), T.StructField("m", T.MapType(T.IntegerType(), T.DoubleType())), T.StructField("n", T.BinaryType()), T.StructField("long name", T.FloatType())])
    rows = spark.createDataFrame([((1, True), [1, None, -5], {300: 1.5, -1: 2.0}, bytearray(b"x"), 0.5), (None, None, None, None, None), ((None, False), [], {}, bytearray(b""), float("nan"))], schema)
    for profile in C.PROFILES:
        items = [bytes(r[0]) for r in rows.select(typed.encode_struct(rows, profile=profile)).collect()]
        assert all(codec.decode_strict(i, profile)[0] == "ACCEPT" for i in items)
        assert items == [codec.encode(codec.to_logical(i), profile) for i in items]
    assert items[1].hex() == "a5" + "6161f6" + "6162f6" + "616df6" + "616ef6" + "696c6f6e67206e616d65f6"


def test_no_rule(spark):
    with pytest.raises(TypeError):
        typed.encode_struct(spark.sql("SELECT CAST(1 AS DECIMAL(10,2)) AS d"))
    with pytest.raises(ValueError, match="profile"):
        C.check_profile("cbor")


def test_null_is_not_an_error(spark):
    rows = spark.createDataFrame([("ok", '{"type":"null"}'), ("bad", "{"), ("none", None)], "id string, v string")
    got = {r["id"]: r["i"] for r in rows.select("id", dynamic.encode_json(F.col("v"), "rfc8949").alias("i")).collect()}
    assert got["ok"] == b"\xf6" and got["bad"] is None and got["none"] is None
    line = rows.select("id", dynamic.result_line(dynamic.decode_strict(dynamic.encode_json(F.col("v"), "rfc8949"), "rfc8949")).alias("l")).collect()
    assert {r["id"]: r["l"] for r in line} == {"ok": "ACCEPT f6", "bad": "", "none": ""}


def test_report_and_dashboard(spark):
    expected = spark.createDataFrame([("a", "P1", "00"), ("b", "P1", "01"), ("c", "P2", "02")], "id string, rule string, expected string")
    actual = spark.createDataFrame([("a", "00"), ("b", "ff")], "id string, actual string")
    results = conformance.compare(expected, actual).withColumns({"adapter": F.lit("x"), "profile": F.lit("rfc8949"), "mode": F.lit("encode")})
    report = conformance.report(results)
    assert {(r["rule"], r["total"], r["passed"], tuple(r["failed_ids"])) for r in report.collect()} == {("P1", 2, 1, ("b",)), ("P2", 1, 0, ("c",))}
    assert not conformance.all_passed(results)
    assert [r["id"] for r in conformance.mismatches(results).collect()] == ["b", "c"]
    top = [r for r in conformance.overall(report).collect() if r["mode"]]
    text = vectors.render_dashboard(top, report.groupBy("rule", "adapter").agg(F.sum("total").alias("total"), F.sum("passed").alias("passed")).collect())
    assert "| x | 1/3 (33%) | 1/3 (33%) |" in text and "| P2 | 0/1 (0%) |" in text
    again = report.withColumn("passed", F.col("total"))
    assert conformance.merge(report, again).agg(F.sum("passed")).first()[0] == 3


def test_vector_files(spark, tmp_path):
    good = [{"id": f"v{k}", "rule": "P1", "rationale": "r", "logical_value": {"type": "int", "value": str(k)}, "expected_hex": codec.integer(k).hex()} for k in (0, 24, 2**64 - 1)]
    good.append({"id": "f", "rule": "fuzz-generated", "logical_value": {"type": "tag", "tag": 2**64 - 1, "value": {"type": "null"}}, "expected_hex": "dbfffffffffffffffff6"})
    bad = [{"id": "r", "rule": "TRAILING_BYTES", "rationale": "r", "input_hex": "0018", "expected_verdict": "reject", "expected_reason": "TRAILING_BYTES"}]
    (tmp_path / "v.json").write_text(json.dumps(good))
    (tmp_path / "r.json").write_text(json.dumps(bad))
    read = vectors.read_vectors(spark, str(tmp_path / "v.json"))
    assert read.select(dynamic.is_valid_json(F.col("logical_value"))).distinct().collect()[0][0]
    both = conformance.compare(read.withColumnRenamed("expected_hex", "expected"), registry.run_encode(read, "dynamic", "rfc8949"))
    assert both.count() == 4 and conformance.all_passed(both)
    lines = vectors.decode_vectors(read, vectors.read_rejects(spark, str(tmp_path / "r.json")))
    assert lines.count() == 4
    assert conformance.all_passed(conformance.compare(lines, registry.run_decode(lines, "dynamic", "dcbor"), want="expected_line"))
    assert conformance.cross(read, registry.table(spark), "dcbor").count() == 8
    (tmp_path / "hex").write_text("00\n\nabc\n 01 \n")
    assert [(r["input_hex"], r["item"] and bytes(r["item"])) for r in vectors.read_hex_lines(spark, str(tmp_path / "hex")).collect()] == [("00", b"\0"), ("abc", None), ("01", b"\1")]
    (tmp_path / "items").mkdir()
    (tmp_path / "items" / "one").write_bytes(b"\x00")
    assert [(r["name"], bytes(r["item"])) for r in vectors.read_items(spark, str(tmp_path / "items")).collect()] == [("one", b"\0")]
    vectors.write_lines(lines, "expected_line", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_corpus(spark):
    made = generate.values(spark, 200)
    assert made.orderBy("id").collect() == generate.values(spark, 200).repartition(7).orderBy("id").collect()
    first = corpus.prefer_first(made, F.col("logical_value"), F.col("id"))
    assert first.count() == made.select("logical_value").distinct().count()
    actual = made.select("id", F.lower(F.hex(dynamic.encode_json(F.col("logical_value"), "dcbor"))).alias("actual_hex"))
    oracle = actual.select("id", F.when(F.col("id").endswith("7"), "00").otherwise(F.col("actual_hex")).alias("oracle_hex"))
    same, other = corpus.agreed(actual, oracle)
    assert other.where("NOT id LIKE '%7'").count() == 0 and same.count() > 100
    capped = corpus.numbered(corpus.capped(same, 50, F.col("id")), "fuzz-dcbor", F.col("id"))
    assert capped.agg(F.min("id"), F.max("id"), F.count("*")).first()[:] == ("fuzz-dcbor-00000", "fuzz-dcbor-00049", 50)
    assert {r["stage"]: r["n"] for r in corpus.stage_counts(all=made, capped=capped).collect()} == {"all": 200, "capped": 50}
    assert registry.differential(made, "dynamic", "dynamic-strict", "rfc8949").count() == 0


def test_canonical(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.5)], "id int, x double")
    got = canonical.dedup(rows.select("id", C.encode_float_dcbor(F.col("x")).alias("i")), F.col("i"), "id").collect()
    assert sorted((r["n"], r["id"]) for r in got) == [(1, 3), (2, 1)]
    assert canonical.divergence(rows, C.encode_float(F.col("x")), C.encode_float_dcbor(F.col("x"))).count() == 2


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, unhex(CASE WHEN id % 2 = 0 THEN '00' ELSE '1817' END) AS item FROM range(10)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counted = validate.reject_counts(validate.validate(stream, "item", "rfc8949"), "ts", "1 hour")
    query = counted.writeStream.outputMode("complete").format("memory").queryName("verdicts").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {(r["verdict"], r["reason"], r["n"]) for r in spark.table("verdicts").collect()} == {("ACCEPT", None, 5), ("REJECT", "NON_SHORTEST_INT", 5)}


@pytest.mark.parametrize(("args", "text", "code", "out"), [
    (["encode", "--profile", "rfc8949"], '{"type":"int","value":"1"}\n\n{"type":"x"}\n{"type":"null"}\n', 1, "01\n\nf6\n"),
    (["decode-strict", "--profile", "dcbor"], "00\n1817\n", 0, "ACCEPT 00\nREJECT NON_SHORTEST_INT\n"),
    (["decode-strict", "--profile", "dcbor"], "zz\n18\n", 1, "\n\n"),
    (["encode"], "", 2, ""), ([], "", 2, ""), (["x", "--profile", "dcbor"], "", 2, ""), (["encode", "--profile", "y"], "", 3, ""),
])
def test_lines(args, text, code, out, monkeypatch, capsys):
    monkeypatch.setattr(sys, "stdin", io.StringIO(text))
    assert cli.main(args) == code
    assert capsys.readouterr().out == out
