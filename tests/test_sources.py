"""Readers of all forms of their files, errors where rows would be lost, writers, rate limits and breakers against plain loops."""

import json

import pytest

from sievelake.operators import governance, states
from sievelake.sources import files


def put(tmp_path, value):
    at = tmp_path / "x.json"
    at.write_text(json.dumps(value))
    return str(at)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_qrels_in_all_forms(spark, tmp_path):
    assert rows(files.read_judgments(spark, put(tmp_path, {"version": 1, "a": ["d", "e"], "b": {"f": 2, "g": 0}}))) == [("a", "d", "document", 1.0), ("a", "e", "document", 1.0), ("b", "f", "document", 2.0)]
    listed = [{"query_id": "a", "target": " t ", "field": "content"}, {"id": "b", "document_name": "n", "relevance": 3}, {"query": "c", "chunk_id": "k"}, {"query_id": "d", "document_id": "i", "expected_chunks": ["x", "y"]}, {"query_id": "e", "expected_documents": "one"}]
    want = [("a", "t", "content", 1.0), ("b", "n", "document", 3.0), ("c", "k", "chunk_id", 1.0), ("d", "i", "document_id", 1.0), ("d", "x", "expected_chunk", 1.0), ("d", "y", "expected_chunk", 1.0), ("e", "one", "document", 1.0)]
    for form in (listed, {"qrels": listed, "version": 2}):
        assert rows(files.read_judgments(spark, put(tmp_path, form))) == want
    for bad in ([{"query_id": "a"}], [{"target": "t"}], {"a": 5}):
        with pytest.raises(Exception, match="needs|must be"):
            files.read_judgments(spark, put(tmp_path, bad)).collect()


def test_other_readers(spark, tmp_path):
    snap = files.read_snapshot(spark, put(tmp_path, {"chunks": [{"chunk_id": "c", "stable_hash": "sha256:x", "aliases": ["y"], "document_name": "d"}]}))
    assert [(r.chunk_id, r.document, sorted(r.aliases)) for r in snap.collect()] == [("c", "d", ["c", "sha256:x", "y"])]
    assert rows(files.read_baseline(spark, put(tmp_path, {"metrics": {"a": 1}, "benchmark": {"metrics": {"b": 2.5, "c": "x"}}}))) == [("b", 2.5)]
    assert rows(files.read_baseline(spark, put(tmp_path, {"metrics": {"a": 1}}))) == [("a", 1.0)]
    for key in ("turns", "messages", "history"):
        assert rows(files.read_session(spark, put(tmp_path, {key: [{"role": "User", "content": "q"}, {"text": "z"}]}))) == [(1, "user", "q"), (2, "user", "z")]
    assert rows(files.read_variants(spark, put(tmp_path, {"queries": ["a", {"query": "b"}]}))) == [(0, "a"), (1, "b")]
    status = files.read_document_status(spark, put(tmp_path, {"data": {"docs": [{"id": 1, "name": "n", "progress": 0.5}]}}))
    assert rows(status) == [(0, "1", "n", None, None, "0.5", None)]
    assert rows(files.read_centroids(spark, put(tmp_path, {"datasets": [{"dataset_id": "d", "centroid": [1, 2]}, {"dataset_id": "e"}]}))) == [("d", [1.0, 2.0])]
    assert rows(files.read_route_tests(spark, put(tmp_path, [{"id": "q", "query": "x?", "expected_kb": "k"}]))) == [(0, "q", "x?", "k", None, None)]
    assert rows(files.read_metadata(spark, put(tmp_path, {"documents": [{"path": "p", "metadata": {"a": "b"}}]}))) == [("p", {"a": "b"})]
    assert files.list_files(spark, str(tmp_path)).count() == 1


def test_writers(spark, tmp_path):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n long")
    assert rows(files.write_artifacts({"t": t, "none": t.limit(0)}, f"{tmp_path}/out")) == [("none", 0), ("t", 2)]
    assert rows(spark.read.json(f"{tmp_path}/out/t").select("name", "n")) == rows(t)
    files.write_tags(t, f"{tmp_path}/csv", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    files.write_segments(spark.createDataFrame([(1, 1, "x\ny"), (1, 2, "z")], "doc_id long, number long, text string"), f"{tmp_path}/seg")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/seg/doc_id=1").collect()) == ["x", "y", "z"]


def test_rate_limits_and_breakers(spark):
    reqs = [("a", float(t), s) for t, s in enumerate(["ok", "bad", "bad", "ok", "ok", "bad", "ok", "ok", "ok"])] + [("b", 5.0, "bad")]
    df = spark.createDataFrame(reqs, "key string, at double, status string")
    got = [(r.allowed, r.state) for r in sorted(states.circuit(df, 2, 3.0, ["bad"]).collect()) if r.key == "a"]
    assert got == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (False, "open"), (True, "open"), (False, "open"), (False, "open"), (True, "closed")]
    burst = spark.createDataFrame([("a", t) for t in (0.0, 0.0, 0.0, 0.0, 10.0)], "key string, at double")
    assert [r.delay_ms for r in sorted(states.rate_limit(burst, 2.0, 2).collect())] == [0.0, 0.0, 500.0, 500.0, 0.0]


def test_hint_conflicts_of_short_hints(spark):
    bases = spark.createDataFrame([(0, "x", ["ab", "long hint"]), (1, "y", ["xaby", "hint"]), (2, "z", [""])], "pos int, name string, hints array<string>")
    assert rows(governance.hint_conflicts(bases)) == [("x", "ab", "y", "xaby"), ("x", "long hint", "y", "hint")]
