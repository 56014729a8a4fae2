"""Vector files: bounded in size when written, parsed without going back to the file when read."""

import json

from pyspark.sql import functions as F

from cborlake.sources import vectors


def test_files_end_at_a_bound_and_hold_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "FILE_CHARS", 2_000, raising=False)
    own = spark.range(500).coalesce(1).select(F.format_string("v-%d", "id").alias("id"), F.lit("P1").alias("rule"), F.format_string('{"type":"int",  "value":"%d"}', "id").alias("logical_value"), F.lit("00").alias("expected_hex"))
    vectors.write_vectors(own, str(tmp_path / "v"))
    files = [f.read_text() for f in (tmp_path / "v").glob("part-*") if f.stat().st_size]
    assert len(files) > 10 and max(map(len, files)) < 2_500 and sum(len(json.loads(f)) for f in files) == 500
    back = vectors.read_vectors(spark, str(tmp_path / "v")).select(own.columns)
    assert back.count() == 500 and back.exceptAll(own).count() == 0  # the JSON text is kept, blanks as well


def test_read_without_going_back_to_the_file(spark, tmp_path):
    for name, text in {"a": '[{"id": "x", "logical_value": {"type":"int", "value": 1.0e2}},\n {"id": "y"}]', "empty": "[]", "blank": " ", "one": '{"id": "z"}', "broken": "[{"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    read = vectors.read_vectors(spark, str(tmp_path))
    assert "json" not in read._jdf.queryExecution().sparkPlan().toString().split("FileScan")[1].split()[0]
    assert sorted((r["id"] or "", r["logical_value"]) for r in read.collect()) == [("", None), ("x", '{"type":"int", "value": 1.0e2}'), ("y", None), ("z", None)]
    assert vectors.read_rejects(spark, str(tmp_path / "a.json")).columns == ["id", "rule", "rationale", "input_hex", "expected_verdict", "expected_reason"]
