"""Readers, writers, streaming, whole runs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from kindred.operators import advisor, scoring
from kindred.plans import pipeline
from kindred.sources import readers, writers
from kindred.streaming import incremental


def test_json_wrappers(spark, tmp_path):
    rows = [{"_key": "1", "name": "Jon"}, {"_key": "2", "name": "John"}]
    for name, content in (("a", {"customers": rows}), ("b", rows), ("c", rows[0])):
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    counts = [readers.read_json(spark, str(tmp_path / f"{n}.json")).count() for n in "abc"]
    assert counts == [2, 2, 1]


def test_delimited_with_a_header_file(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("k\tv\n")
    (tmp_path / "d.tsv").write_bytes(b"1\tcaf\xc3\xa9\n2\tbad\xff\n")
    df = readers.read_delimited(spark, str(tmp_path / "d.tsv"), header_path=str(tmp_path / "h.tsv"))
    assert df.columns == ["k", "v"] and df.filter("k = '1'").first()["v"] == "café" and df.count() == 2


def test_ground_truth(spark, tmp_path):
    (tmp_path / "t.csv").write_text("record_a_id,record_b_id,is_match\nb,a,true\nc,d,no\ne,f,1\n")
    found = sorted(tuple(r) for r in readers.read_ground_truth(spark, str(tmp_path / "t.csv")).collect())
    assert found == [("a", "b"), ("e", "f")]
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_ground_truth(spark, str(tmp_path / "x.csv"))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("c", 2, ["a", "b"])], "cluster_id string, size int, member_keys array<string>")
    writers.export_clusters(df, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x/json")).first()["member_keys"] == ["a", "b"]
    assert spark.read.option("header", True).csv(str(tmp_path / "x/csv")).first()["member_keys"] == '["a","b"]'
    done = []
    steps = [lambda s: done.append(1), lambda s: done.append(2)]
    assert writers.migrate(spark, str(tmp_path / "v"), steps[:1]) == 1
    assert writers.migrate(spark, str(tmp_path / "v"), steps) == 2 and done == [1, 2]


def test_stream_meets_the_table(spark, tmp_path):
    docs = spark.createDataFrame([("1", "Jonathan Smith"), ("2", "Mary Jones")], "_key string, name string")
    spark.createDataFrame([("9", "jonathan smith"), ("8", "Nobody")], "_key string, name string").write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("_key string, name string").parquet(str(tmp_path / "in"))
    query = incremental.resolve_stream(stream, lambda: docs, lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"), ["name"])
    query.awaitTermination(120)
    assert [(r["record_key"], r["doc_key"], r["score"]) for r in got] == [("9", "1", 1.0)]


def test_run_and_config(spark):
    rows = [(1, "x", "john smith"), (2, "x", "john smith"), (3, "x", "jane doe"), (4, "y", "john smith")]
    docs = spark.createDataFrame(rows, "_key int, k string, name string")
    config = pipeline.Config.from_text(json.dumps({"blocking_fields": ["k"], "fields": [["name", 1.0, "levenshtein"]], "golden_fields": ["name"]}))
    found = pipeline.run(docs, config, "t")
    assert found.metrics() == {"edges": 1, "clusters": 1, "members": 2}
    assert found.golden.first()["name"] == "john smith" and found.golden.first()["member_keys"] == ["1", "2"]
    with pytest.raises(ValueError):
        pipeline.Config.from_text('{"blocking_fields": [], "fields": []}')


def test_custom_similarity(spark):
    from kindred.functions.names import similarity_udf

    docs = spark.createDataFrame([(1, "ab"), (2, "cd")], "_key int, n string")
    p = spark.createDataFrame([(1, 2)], "doc1_key int, doc2_key int")
    same_length = similarity_udf(lambda a, b: float(len(a) == len(b)))
    assert scoring.score_pairs(p, docs, [scoring.Field("n", 1.0, same_length)], 0.5).first()["score"] == 1.0


def test_advice():
    fields = (advisor.FieldProfile("a", 0.0, 0.9), advisor.FieldProfile("b", 0.5, 0.1))
    profile = advisor.DatasetProfile(1000, fields)
    keys = advisor.blocking_keys(profile, ["a", "b"])
    assert keys[0]["fields"] == ("a",) and keys[0]["candidate_pairs"] == 20000
    assert advisor.strategies(profile, advisor.Objective("recall_first"))[0]["score"] >= advisor.strategies(profile, advisor.Objective("recall_first"))[-1]["score"]
    assert 0 <= advisor.variant_score(advisor.variant_metrics(2)) <= 1
    assert len(advisor.Export({"a": 1}).sha256()) == 64


def test_verification_budget_and_failures(spark):
    scored = spark.createDataFrame([("a", "b", 0.7), ("c", "d", 0.8), ("e", "f", 0.9), ("g", "h", 0.1)], "doc1_key string, doc2_key string, score double")
    verdicts = lambda df: df.select("doc1_key", "doc2_key", F.lit("match").alias("verdict"), F.lit(1.0).alias("confidence"))
    found = {r["doc1_key"]: (r["final_score"], r["review"]) for r in scoring.verification_band(scored, verdicts, budget=1).collect()}
    assert found == {"a": (0.7, "pending_review"), "c": (1.0, "match"), "e": (0.9, "auto_match"), "g": (0.1, "auto_no_match")}
