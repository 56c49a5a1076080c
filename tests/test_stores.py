import json

import pytest

from tallyweave.operators import runs as rn
from tallyweave.sources import benchmarks as bm
from tallyweave.sources import config, stores
from tallyweave.streaming import monitor


def test_runs_and_reports(spark, tmp_path):
    rel = spark.createDataFrame([("rel1", "s1", "f1", "consensus", 0.9), ("rel2", "s2", "f9", "b_only", 0.3)], "relation_id string, summary_row_id string, footnote_row_id string, agreement string, confidence double")
    rows = spark.createDataFrame([("s1", "Kasa"), ("f1", None)], "row_id string, label_raw string")
    checks = spark.createDataFrame([("format", "pass")], "grp string, status string")
    stores.write_run(str(tmp_path), "r1", {"relations": rel, "rows": rows}, {"state": "done", "duration_s": 1.5})
    assert stores.read_run(spark, str(tmp_path), "relations", "r1").count() == 2
    assert stores.read_run(spark, str(tmp_path), "relations", "nope") is None
    lines = sorted(json.loads(r.value)["summary_label"] for r in stores.relation_lines(rel, rows).collect())
    assert lines == ["", "Kasa"]
    page = stores.report_html(rel, checks)
    assert page.index("rel2") < page.index("rel1") and "class='low'" in page


def test_labels_and_annotations(spark, tmp_path):
    root = str(tmp_path)
    assert stores.read_labels(spark, root).count() == 0
    stores.put_label(spark, root, "r", "relation", "k1", "accept")
    stores.put_label(spark, root, "r", "relation", "k2", "reject")
    stores.put_label(spark, root, "r", "relation", "k1", None)
    assert [(r.key, r.label) for r in stores.read_labels(spark, root).collect()] == [("k2", "reject")]
    with pytest.raises(ValueError):
        stores.put_label(spark, root, "r", "relation", "k", "maybe")
    note = spark.createDataFrame([("a", "sha", 1, "k", ["x", "y"], "n", None)], stores.NOTE_SCHEMA)
    stores.put_annotations(root, note)
    assert stores.flat_annotations(spark.read.parquet(f"{root}/annotations")).first().object_ids == "x;y"
    with pytest.raises(ValueError):
        stores.put_annotations(root, note.withColumn("page", note.page - 1))
    stores.export(stores.flat_annotations(note), f"{root}/out", "csv")
    assert spark.read.option("header", "true").csv(f"{root}/out").first().annotation_id == "a"


def test_fingerprints(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    got = stores.fingerprints(spark, str(tmp_path)).first()
    assert got.length == 3 and got.sha256.startswith("ba7816bf")


def test_config_layers():
    s = config.settings({"linking": {"accept_threshold": 0.9}}, {"linking": {"accept_threshold": 0.1, "lexical_threshold": 0.3}}, {"TALLYWEAVE_OCR__DPI": "400", "OTHER": "x"})
    assert s["linking"]["accept_threshold"] == 0.9 and s["linking"]["lexical_threshold"] == 0.3 and s["ocr"]["dpi"] == 400
    assert config.DEFAULTS["ocr"]["dpi"] == 300 and len(config.SCENARIOS) == 18
    assert config.scenario("llm-tier")["linking"]["llm"]["enabled"] is True
    first = config.config_id(b"x", {"a": 1})
    assert config.config_id(b"x", {"a": 2}, {first: "other"}).startswith(first + "-")


def test_upload_fields():
    good = config.upload_fields({"company": " A ", "currency": "eur", "period_end": "2012-12-31", "summary_pages": [5, 7], "control_pages": [9, 9, 10]})
    assert good["control_pages"] == [9, 10] and good["currency"] == "EUR"
    assert config.upload_fields({"company": "a"})["currency"] == "TL" and config.upload_fields({"company": "a", "lang": "CHI_SIM"})["lang"] == "chi_sim"
    for bad in ({"company": ""}, {"company": "a", "period_end": "31.12.2012"}, {"company": "a", "currency": "us 1"}, {"company": "a", "currency": "dollars_us"}, {"company": "a", "currency": "_"}, {"company": "a", "lang": "tur eng"}, {"company": "a", "summary_pages": [5, 7], "page_count": 7}, {"company": "a", "summary_pages": [5, 7], "page_count": 9, "control_pages": [10]}, {"company": "a", "summary_pages": [7, 5]}, {"company": "a", "summary_pages": [5, 7], "control_pages": [6]}, {"company": "a", "footnote_no": 100}):
        with pytest.raises(config.FieldError):
            config.upload_fields(bad)


def test_benchmark_problems(spark):
    rows = spark.createDataFrame([("a", 1.0, "t"), ("a", 2.0, "t")], "id string, n double, s string")
    assert bm.problems([("n", "number"), ("s", "text")], rows.dropDuplicates(["id"]), "a") == []
    assert len(bm.problems([("n", "text"), ("n", "text"), ("id", "text")], rows, "zz")) == 6


def test_run_diff_and_cost(spark):
    a = spark.createDataFrame([("k1", 0.9), ("k2", 0.5)], "key string, confidence double")
    b = spark.createDataFrame([("k2", None), ("k3", 0.1)], "key string, confidence double")
    got = {r.key: (r.side, r.confidence_changed) for r in rn.diff(a, b, ["key"], ["confidence"]).collect()}
    assert got == {"k1": ("only_a", True), "k2": ("both", True), "k3": ("only_b", True)}
    # seven published confidences: six reviews at p* = 0.95, cost 6.43; none reviewed 15.79
    conf = [0.8734, 0.8416, 0.8164, 0.8583, 0.9785, 0.9088, 0.9337]
    rels = spark.createDataFrame([(1, c, False) for c in conf], "g int, confidence double, low_confidence boolean")
    cost = rn.expected_cost(rels, ["g"], 1, 20).first()
    assert (cost.review, round(cost.at_p_star, 2), cost.review_all, round(cost.review_none, 2)) == (6, 6.43, 7.0, 15.79)
    assert rn.expected_cost(rels, ["g"], 4, 20).first().review == 0


def test_stream_equals_batch(spark, small_dir, tmp_path):
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = monitor.read_events(spark, str(tmp_path / "in"), events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    monitor.write_rates(monitor.rates(stream, late="60 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.schema("start timestamp, events bigint, bad bigint, value double").parquet(str(tmp_path / "out")).count()
    want = monitor.rates(events).count()
    assert 0 <= got <= want  # windows inside the watermark stay open
    memory = monitor.rates(monitor.read_events(spark, str(tmp_path / "in"), events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    memory.awaitTermination()
    assert sorted(map(str, spark.table("rates").select("start", "events", "bad").collect())) == sorted(map(str, monitor.rates(events).select("start", "events", "bad").collect()))
