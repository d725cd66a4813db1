"""Sources, sinks and streams."""

from __future__ import annotations

import json

import numpy as np

from weftline.sources import io
from weftline.streaming import windows


def test_bundles(spark, tmp_path):
    (tmp_path / "b").mkdir()
    bundle = {"vfp_id": "v1", "affected_files": {"A.sol": "contract A {}"}, "findings": [
        {"id": 1, "title": "t", "category": {"1": ["CWE-1"]}, "location": ["A.sol::f"]}, {"id": 2, "title": None}]}
    (tmp_path / "b/vfp_1.json").write_text(json.dumps(bundle, indent=2))
    (tmp_path / "b/vfp_2.json").write_text("{ broken")
    (tmp_path / "b/vfp_3.json").write_text(json.dumps({"vfp_id": "v3", "affected_files": {}, "findings": []}))
    got = io.read_bundles(spark, str(tmp_path / "b"))
    assert [r["id"] for r in io.findings_of(got).collect()] == [1, 2]
    assert [tuple(r) for r in io.files_of(got).collect()] == [("v1", 0, "A.sol", "contract A {}")]


def test_sources_and_items(spark, tmp_path):
    (tmp_path / "s/deep").mkdir(parents=True)
    (tmp_path / "s/deep/A.sol").write_text("contract A {\n}")
    (tmp_path / "s/readme.md").write_text("no source")
    got = io.read_sources(spark, str(tmp_path / "s"), bundle="lib").collect()
    assert [(r["text"], r["bundle"]) for r in got] == [("contract A {\n}", "lib")]
    df = spark.createDataFrame([(1, "train"), (2, "val")], "i int, split string")
    io.write_items(df, str(tmp_path / "out"), by=["split"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert "| 1 | train |" in io.render_report("R", {"rows": df.orderBy("i")})
    io.save_weights(spark, {"w": np.array([[1.0, 2.0]]), "t": 0.25}, str(tmp_path / "w"))
    back = io.load_weights(spark, str(tmp_path / "w"))
    assert back["w"].tolist() == [[1.0, 2.0]] and float(back["t"]) == 0.25
    there, missing = io.with_existing(df, df.where("i = 1").select("i"), "i")
    assert there.count() == 1 and missing.first()["missing"] == 1


def test_annotations(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.json").write_text(json.dumps({"filePath": "x.sol", "SWCs": [{"category": "SWC-107-R", "function": "f", "lineNumber": "L1-2"}]}))
    got = io.read_annotations(spark, str(tmp_path / "a")).collect()
    assert [(r["filePath"], r["category"]) for r in got] == [("x.sol", "SWC-107-R")]


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    batch.selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "in"))
    events = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling_counts(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r)[:3] for r in windows.tumbling_counts(events, "1 hour").collect()}
    assert {tuple(r)[:3] for r in spark.table("w").collect()} == want
