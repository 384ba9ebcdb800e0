"""Small cases: sources, routing, metrics, streams, texts with odd characters."""

import json

from pyspark.sql import functions as F

from sievelake.functions import cleaning, text as tx
from sievelake.operators import conversation, corpus, metrics, retrieval
from sievelake.sources import files
from sievelake.streaming import windows


def test_sources(spark, tmp_path):
    put = lambda n, x: (tmp_path / n).write_text(x if isinstance(x, str) else json.dumps(x)) and str(tmp_path / n)
    q = files.read_queries(spark, put("q.json", {"queries": [{"id": "a", "query": "x?"}, {"id": "b", "question": "y?"}]}))
    assert [(r.query_id, r.question) for r in q.orderBy("query_id").collect()] == [("a", "x?"), ("b", "y?")]
    listed = files.read_qrels(spark, put("r.json", [{"query_id": "a", "document": "d", "relevance": 2.0, "expected_chunks": ["c"]}, {"query_id": "a", "document": "e", "relevance": 0.0}]))
    assert sorted(map(tuple, listed.collect())) == [("a", "c", "chunk", 2.0), ("a", "d", "document", 2.0)]
    assert [tuple(r) for r in files.read_qrels(spark, put("m.json", {"a": {"d": 1, "e": 0}})).collect()] == [("a", "d", "document", 1.0)]
    g = files.read_gate(spark, put("g.json", {"thresholds": {"min_mrr": 0.5, "max_hit_drop": 0.1}}))
    assert sorted(map(tuple, g.collect())) == [("hit", "drop", 0.1), ("mrr", "min", 0.5)]
    logs = files.read_logs(spark, put("x.log", "parse: 12 ms\nnothing\nembed=3.5s\n"))
    assert sorted(map(tuple, logs.collect())) == [("embed", 3500.0), ("parse", 12.0)]


def test_route(spark):
    bases = spark.createDataFrame([("tax guide", ["vat rate"], "about money"), ("pets", ["dog"], "animals")], "name string, hints array<string>, description string")
    qs = spark.createDataFrame([("1", "What VAT rate applies to money?"), ("2", "none")], "query_id string, question string")
    assert sorted(map(tuple, conversation.route(qs, bases, "pets").collect())) == [("1", 10.25, "tax guide", False), ("2", 0.0, "pets", True)]


def test_metrics_bounds_and_values(spark):
    hits = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3)], "query_id string, doc_id long, rank long")
    rel = spark.createDataFrame([("q", 2, 1.0), ("q", 9, 1.0), ("z", 1, 1.0)], "query_id string, doc_id long, relevance double")
    got = {r.query_id: r for r in metrics.query_metrics(hits, rel, 3).collect()}
    assert (got["q"].mrr, got["q"].recall, got["q"].map) == (0.5, 0.5, 0.25)
    assert got["z"].hit == got["z"].ndcg == 0.0


def test_text(spark):
    rows = [(1, "a  b　"), (2, "a b"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    h = {r.doc_id: r for r in corpus.exact_groups(df).collect()}
    assert h[2].first_id == 1 and not h[2].kept and h[3].kept and 4 not in h
    one = spark.createDataFrame([("中 文 字\r\nﬁx  \n\n\n\nend",)], "t string")
    got = one.select(cleaning.clean_all(F.col("t"), ["crlf", "trailing", "blank", "cjk", "ligature", "final_newline"])).first()[0]
    assert got == "中文字\nfix\n\nend\n"
    assert one.select(tx.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))).first()[0] == 0.5


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    qs = spark.createDataFrame([], "query_id string, question string")
    assert retrieval.lexical_topk(docs, qs).count() == corpus.domain_overlap(docs).count() == corpus.exact_groups(docs).count() == 0


def test_stream_matches_batch(spark, tmp_path):
    at = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(at).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    batch.repartition(3).write.parquet(folder)
    q = windows.tumbling_counts(spark.readStream.schema(batch.schema).parquet(folder), late="400 days").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect()), key=str) == sorted(map(tuple, windows.tumbling_counts(batch).collect()), key=str)
