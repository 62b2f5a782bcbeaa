import json
import os

import pandas as pd
import pytest

from pyspark.sql import functions as F

from dossier.operators import pages as ops
from dossier import session
from dossier.plans import papers
from dossier.sources import folders, rules, sinks
from dossier.streaming import pages as streaming


def _tree(root):
    for path in ("T1/B1/a.pdf", "T1/B1/b.pdf", "T1/B2/a.pdf", "T1/loose.pdf", "T2/x.pdf", "T3/readme.txt", "T1/_output/r.pdf", "T4[1]/B/z.pdf"):
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(b"%PDF")


def test_folders(spark, tmp_path):
    root = f"{tmp_path}/in box"
    _tree(root)
    got = {(r.tender_id, r.bidder_name, r.source_file) for r in folders.papers(spark, root).collect()}
    assert got == {("T1", "B1", "a.pdf"), ("T1", "B1", "b.pdf"), ("T1", "B2", "a.pdf"), ("T2", "T2", "x.pdf"), ("T4[1]", "B", "z.pdf")}
    assert {tuple(r) for r in folders.folder_counts(spark, root).collect()} == {("T1", 3, False), ("T2", 1, False), ("T3", 0, True), ("T4[1]", 1, False)}


def test_replace_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, "k")
    sinks.replace_partitions(spark.createDataFrame([("b", 3), ("b", 4)], "k string, v int"), path, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3), ("b", 4)}
    nested = sinks.as_json_text(spark.createDataFrame([(1, [1, 2])], "k int, a array<int>")).first()
    assert nested.a == "[1,2]"


def test_stream(spark, tmp_path):
    rows = [("t", "b", "f", k % 5, "ocr", f"2023-01-01 0{k % 3}:00:00") for k in range(20)]
    frame = spark.createDataFrame(rows, "tender_id string, bidder_name string, source_file string, page_number int, source string, read_at string").withColumn("read_at", F.col("read_at").cast("timestamp_ntz"))
    frame.repartition(4).write.parquet(f"{tmp_path}/p")
    stream = streaming.arriving(spark, f"{tmp_path}/p", 1)
    assert {(str(r.hour), r.pages) for r in streaming.settled(streaming.hourly(stream)).collect()} == {("2023-01-01 00:00:00", 7), ("2023-01-01 01:00:00", 7), ("2023-01-01 02:00:00", 6)}
    once = streaming.settled(streaming.first_readings(streaming.arriving(spark, f"{tmp_path}/p", 1)), "append")
    assert once.count() == 5


def test_types_and_patterns(spark):
    pages = spark.createDataFrame(
        [(1, "ANNUAL TURNOVER CERTIFICATE\nMembership No. 123456\nUDIN: 24422111AVGUFK1719"), (2, "undertaking: never blacklisted"), (3, None), (4, "")], "page_id bigint, text string"
    )
    typed = ops.classified(pages)
    assert {r.page_id: (r.doc_type, r.score) for r in typed.collect()} == {1: ("TURNOVER_CERTIFICATE", 12), 2: ("UNDERTAKING", 3), 3: (None, 0), 4: (None, 0)}
    fields = {(r.page_id, r.field_name): r.field_value for r in ops.pattern_fields(typed).collect()}
    assert fields == {(1, "membership_number"): "123456", (1, "frn"): "422111A", (1, "udin"): "24422111AVGUFK1719", (1, "date"): None}
    assert ops.missing_required(ops.pattern_fields(typed)).count() == 0


def test_missing_required_and_notes(spark):
    pages = spark.createDataFrame([(1, "ANNUAL TURNOVER CERTIFICATE of the firm"), (2, "Permanent Account Number Card ABCDE1234F")], "page_id bigint, text string")
    read = ops.pattern_fields(ops.classified(pages))
    assert [tuple(r) for r in ops.missing_required(read).collect()] == [(1, "TURNOVER_CERTIFICATE", "membership_number, udin")]
    assert {(r.field_name, r.note) for r in ops.notes(read).where("page_id = 2").collect()} == {("pan_number", "regex"), ("dob", "missing")}


def test_scores_read_the_text_once(spark):
    pages = spark.createDataFrame([(1, "undertaking: never blacklisted")], "page_id bigint, text string")
    plan = ops.positive(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1
    assert [tuple(r) for r in ops.positive(pages).collect()] == [(1, "UNDERTAKING", 3)]


def test_rule_files(spark, tmp_path):
    types = {"document_types": {"B": {"label": "Bee", "min_score": 2, "detect": {"any_of_high": [{"phrase": "buzz", "weight": 3, "requires_with": ["wing"]}], "supporting": [{"phrase": "hive", "weight": 1}]}, "fields": {"n": {"regex": "\\\\d+", "context": "No", "required": True}, "free": {"type": "llm"}}}, "A": {"detect": {}}}}
    path = f"{tmp_path}/types.json"
    with open(path, "w") as f:
        json.dump(types, f)
    found, fields = rules.read_types(spark, path)
    assert found == [("B", "Bee", 2, [("buzz", 3, ["wing"]), ("hive", 1, [])]), ("A", "A", 1, [])]
    assert [(f[0], f[1], f[3], f[4]) for f in fields] == [("B", "n", "No", True)]
    pages = spark.createDataFrame([(1, "buzz of a wing")], "page_id bigint, text string")
    assert ops.classified(pages, types=found).first().doc_type == "B"
    with open(f"{tmp_path}/more.json", "w") as f:
        f.write("{}")
    assert rules.read_types(spark, f"{tmp_path}/more.json") == ([], [])
    with pytest.raises(ValueError):
        rules.read_types(spark, f"{tmp_path}/*.json")


def test_eligibility_files(spark, tmp_path):
    root = f"{tmp_path}/in box"
    for tender, criteria in (("T+1 a", [{"id": "x", "label": "X", "min_value_inr": 5}, {"id": "y", "label": "Y"}]), ("T2", None), ("T3", [])):
        os.makedirs(f"{root}/{tender}")
        if criteria is not None:
            with open(f"{root}/{tender}/eligibility_rules.json", "w") as f:
                json.dump({"tender_id": "other", "estimated_cost_inr": 7, "criteria": criteria}, f, indent=1)
    with open(f"{tmp_path}/default.json", "w") as f:
        json.dump({"criteria": [{"id": "d", "label": "D"}]}, f)
    got = {(r.tender_id, r.by_default, r.ord, r.id, r.min_value_inr) for r in rules.read_eligibility(spark, root, f"{tmp_path}/default.json").collect()}
    assert got == {("T+1 a", False, 1, "x", 5.0), ("T+1 a", False, 2, "y", None), ("T2", True, 1, "d", None)}


def test_taken_names():
    batch = pd.DataFrame({"source_folder": list("abcdefg"), "base": ["X", "X", "X_2", "X", "X_2", "Y", "Y"], "stem": ["X"] * 5 + ["Y"] * 2})
    assert list(next(papers._placed(iter([batch]))).dest_name) == ["X", "X_2", "X_2_2", "X_3", "X_2_3", "Y", "Y_2"]


def test_release_and_spread(spark, tmp_path):
    table = session.settle(spark.range(5))
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    assert session.release(spark) >= 1
    assert not os.path.exists(path)
    assert session.spread(spark.range(8, numPartitions=1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(8, numPartitions=9), "id").rdd.getNumPartitions() == 9
