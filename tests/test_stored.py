"""Stored reports, query sets, stores and whole pipelines on small literal tables."""

import json

from quillspark.operators import pipeline
from quillspark.sources import stored


def test_baseline_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    assert stored.baseline(spark, path).count() == 0
    stored.write_baseline(spark.createDataFrame([("relevance", 0.9), ("accuracy", 0.5)], "metric string, value double"), path)
    assert {tuple(r) for r in stored.baseline(spark, path).collect()} == {("relevance", 0.9), ("accuracy", 0.5)}
    (tmp_path / "bad.json").write_text("{")
    assert stored.baseline(spark, f"file://{tmp_path}/bad.json").count() == 0


def test_labelled_queries(spark):
    templates = spark.createDataFrame([("refund-01", ["A b"], ["s"], ["q1", "q2"], ["f"], {"A b": 2}, "c", "factoid"), ("noanswer-01", [], [], ["q3", "q4"], [], {}, "no_answer", "no_answer")], "template string, titles array<string>, sections array<string>, queries array<string>, facts array<string>, grades map<string,int>, category string, query_type string")
    corpus = spark.createDataFrame([("A b", "x")], "title string, content string")
    got = {r["id"]: r for r in stored.labelled_queries(templates, corpus).collect()}
    assert {i: r["role"] for i, r in got.items()} == {"refund-01-1": "test", "refund-01-2": "test", "noanswer-01-1": "calibration", "noanswer-01-2": "calibration"}
    one = got["refund-01-2"]
    assert one["query"] == "q2" and one["relevance"] == {one["relevant_source_ids"][0]: 2} and one["relevant_sections"] == ["s"] and not one["no_answer"]
    assert got["noanswer-01-1"]["no_answer"] and got["noanswer-01-1"]["relevance"] == {}


def test_stores(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"id": "a", "title": "t", "content": "c"}, {"id": " ", "title": "t", "content": "d", "chunkIndex": 1}, {"id": "x", "content": "  "}]))
    got = [r["id"] for r in stored.knowledge_store(spark, f"file://{tmp_path}/s.json").orderBy("content").collect()]
    assert got[0] == "a" and len(got) == 2 and len(got[1]) == 32
    files = spark.createDataFrame([("d/a.json", '{"instructions": " do ", "keywords": ["k"]}'), ("d/b.json", '{"name": "n"}'), ("d/c.json", "broken")], "path string, text string")
    assert [tuple(r) for r in stored.json_skills(files).collect()] == [("a", "do", ["k"])]


def test_search_rewrites_and_ranks(spark):
    docs = spark.createDataFrame([(1, "退货 时效 三天", "售后"), (2, "配送 快递", "物流"), (3, "unrelated", "x"), (4, None, "y")], "doc_id long, text string, section string")
    queries = spark.createDataFrame([(1, "退款多久"), (2, "")], "item_id long, text string")
    for name in ("r1", "r3", "r4"):
        found = pipeline.search(queries, docs, pipeline.VARIANTS[name], k=2).collect()
        ids = {r["query_id"]: r["doc_id"] for r in found if r["pos"] == 1}
        assert ids == ({1: 1} if name != "r3" else {1: 1}), name
    assert pipeline.search(queries, docs, pipeline.VARIANTS["r4"], k=2, min_score=1.0).count() == 0


def test_merged_answers_and_context(spark):
    rows = spark.createDataFrame([(1, 1, "billing", "b", True), (1, 0, "technical", "a", False)], "request_id int, ord int, agent string, content string, escalate boolean")
    got = pipeline.merged_answers(rows).first()
    assert got["content"].startswith("[technical - 主处理]\na\n\n[billing - 辅助处理]") and got["escalated"]
    hits = spark.createDataFrame([(1, 1, None, " ", 0.5), (1, 2, None, "x" * 700, 0.25)], "query_id int, pos int, title string, content string, score double")
    context = pipeline.knowledge_context(hits).first()["context"]
    assert "2. 标题: 未命名文档" in context and "1. " not in context and context.count("x") == 600
