"""Readers: query sets, relevance judgments, gates, routing tables, Markdown folders and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERY = "struct<id:string,question:string,query:string,min_chunks:int,expected_terms:array<string>,expected_documents:array<string>,top_k:int>"
_QREL = "struct<query_id:string,document:string,chunk_id:string,relevance:double,expected_documents:array<string>,expected_chunks:array<string>>"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _either(field: str, item: str):
    """An array under ``field``, or a bare array."""
    return F.coalesce(F.from_json("value", f"struct<{field}:array<{item}>>")[field], F.from_json("value", f"array<{item}>"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query sets: {"queries": [...]} or a list; ``query`` stands in for ``question``."""
    q = _whole(spark, path).select(F.explode(_either("queries", _QUERY)).alias("q"))
    return q.select(F.col("q.id").alias("query_id"), F.coalesce("q.question", "q.query").alias("question"), F.coalesce("q.min_chunks", F.lit(1)).alias("min_chunks"), "q.expected_terms", "q.expected_documents", "q.top_k")


def _text(v: Column, *keys: str) -> Column:
    """The first of the fields that is there, as text."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{k}", "string") for k in keys))


def _texts(v: Column, key: str) -> Column:
    """A field as a list of texts; one text is a list of one."""
    return F.coalesce(F.try_variant_get(v, f"$.{key}", "array<string>"), F.array(F.try_variant_get(v, f"$.{key}", "string")), F.array().cast("array<string>"))


def _items(spark: SparkSession, path: str, *fields: str) -> DataFrame:
    """(pos, v) of the objects in a JSON file: a list at its top or under one of the fields (dots lead inward)."""
    raw = _whole(spark, path).select(F.parse_json("value").alias("d"))
    lists = [F.try_variant_get("d", f"$.{f}", "array<variant>") for f in fields] + [F.try_variant_get("d", "$", "array<variant>")]
    return raw.select(F.posexplode(F.coalesce(*lists)).alias("pos", "v"))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """Judgments (query_id, target, field, relevance) above 0.

    A list (or one under ``qrels``) of objects with a target, a document or a chunk, and lists of
    further expected documents and chunks; or an object of queries, each with an object of targets
    and their relevance or a list of targets. Anything else is an error, no row is left out.
    """
    raw = _whole(spark, path).select(F.parse_json("value").alias("d"))
    listed = F.coalesce(F.try_variant_get("d", "$.qrels", "array<variant>"), F.try_variant_get("d", "$", "array<variant>"))
    v = F.col("v")
    item = raw.where(listed.isNotNull()).select(F.explode(listed).alias("v"))
    query = F.trim(_text(v, "query_id", "id", "query"))
    row = lambda field, target: F.struct(field.alias("field"), target.alias("target"))
    own = F.coalesce(
        F.when(_text(v, "target").isNotNull(), row(F.coalesce(_text(v, "field"), F.lit("document")), _text(v, "target"))), F.when(_text(v, "chunk_id").isNotNull(), row(F.lit("chunk_id"), _text(v, "chunk_id"))),
        F.when(_text(v, "document_id").isNotNull(), row(F.lit("document_id"), _text(v, "document_id"))), F.when(_text(v, "document", "document_name", "doc", "doc_name").isNotNull(), row(F.lit("document"), _text(v, "document", "document_name", "doc", "doc_name"))),
    )
    some = lambda field, key: F.transform(_texts(v, key), lambda x: row(F.lit(field), x))
    rows = F.filter(F.concat(F.array(own), some("document", "expected_documents"), some("expected_chunk", "expected_chunks")), lambda r: r["target"].isNotNull())
    bad = F.raise_error(F.concat(F.lit("a judgment needs query_id and a target: "), v.cast("string")))
    rows = F.when((F.coalesce(query, F.lit("")) != "") & (F.size(rows) > 0), rows).otherwise(bad)
    first = item.select(query.alias("query_id"), F.explode(rows).alias("r"), F.coalesce(F.try_variant_get(v, "$.relevance", "double"), F.lit(1.0)).alias("relevance"))
    named = raw.where(listed.isNull()).select(F.explode(F.variant_get("d", "$", "map<string,variant>")).alias("query_id", "v")).where(~F.col("query_id").isin("version", "schema", "metadata"))
    graded = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,double>")), lambda e: F.struct(e["key"].alias("target"), e["value"].alias("relevance")))
    plain = F.transform(F.try_variant_get(v, "$", "array<string>"), lambda x: F.struct(x.alias("target"), F.lit(1.0).alias("relevance")))
    second = named.select("query_id", F.explode(F.coalesce(graded, plain, F.raise_error(F.concat(F.lit("judgments must be an object or a list: "), "query_id")))).alias("r"))
    out = first.select("query_id", F.trim("r.target").alias("target"), "r.field", "relevance").unionByName(second.select("query_id", F.trim("r.target").alias("target"), F.lit("document").alias("field"), "r.relevance"))
    return out.where("relevance > 0")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """:func:`read_judgments` as (query_id, target, kind, relevance), the kind being document, chunk or content."""
    kind = F.when(F.col("field").startswith("document"), "document").when(F.col("field") == "content", "content").otherwise("chunk")
    return read_judgments(spark, path).select("query_id", "target", kind.alias("kind"), "relevance")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(pos, chunk_id, document, stable_hash, aliases, content) of a chunk snapshot."""
    v = F.col("v")
    aliases = F.array_distinct(F.concat(_texts(v, "aliases"), F.array_compact(F.array(*(_text(v, k) for k in ("stable_hash", "content_sha256", "chunk_id", "source_chunk_id"))))))
    return _items(spark, path, "chunks").select("pos", _text(v, "chunk_id", "source_chunk_id").alias("chunk_id"), _text(v, "document_name", "document_id").alias("document"), _text(v, "stable_hash", "content_sha256").alias("stable_hash"), aliases.alias("aliases"), _text(v, "content").alias("content"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(metric, actual) of a report: the numbers under benchmark.metrics, else under metrics."""
    raw = _whole(spark, path).select(F.parse_json("value").alias("d"))
    m = F.coalesce(F.try_variant_get("d", "$.benchmark.metrics", "map<string,variant>"), F.try_variant_get("d", "$.metrics", "map<string,variant>"))
    return raw.select(F.explode(m).alias("metric", "v")).select("metric", F.try_variant_get("v", "$", "double").alias("actual")).where("actual IS NOT NULL")


def read_route_tests(spark: SparkSession, path: str) -> DataFrame:
    """(pos, query_id, question, expected, category, locale) of route tests."""
    v = F.col("v")
    cols = {"query_id": ("id", "query_id"), "question": ("question", "query"), "expected": ("expected_kb", "expected"), "category": ("category",), "locale": ("locale",)}
    return _items(spark, path, "queries", "cases", "tests").select("pos", *(_text(v, *k).alias(c) for c, k in cols.items()))


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """(turn, role, text) of a session, from turns, messages or history, numbered from 1."""
    v = F.col("v")
    return _items(spark, path, "turns", "messages", "history").select((F.col("pos") + 1).alias("turn"), F.lower(F.coalesce(_text(v, "role"), F.lit("user"))).alias("role"), _text(v, "content", "text", "message").alias("text"))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(pos, query) of query variants: texts or objects, at the top or under queries."""
    v = F.col("v")
    return _items(spark, path, "queries").select("pos", F.coalesce(F.try_variant_get(v, "$.query", "string"), F.try_variant_get(v, "$", "string")).alias("query"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, metadata) of document metadata."""
    v = F.col("v")
    return _items(spark, path, "documents").select(_text(v, "path").alias("path"), F.try_variant_get(v, "$.metadata", "map<string,string>").alias("metadata"))


def read_document_status(spark: SparkSession, path: str) -> DataFrame:
    """(pos, document_id, name, run, status, progress, message) of a status listing in any of its envelopes."""
    v = F.col("v")
    cols = {"document_id": ("id", "document_id"), "name": ("name", "document_name"), "run": ("run",), "status": ("status",), "progress": ("progress",), "message": ("progress_msg", "message", "error")}
    return _items(spark, path, "data.docs", "data.documents", "documents", "items", "list", "document_states").select("pos", *(_text(v, *k).alias(c) for c, k in cols.items()))


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(label, centroid) of a centroid index; entries without a vector are left out."""
    v = F.col("v")
    vector = F.coalesce(F.try_variant_get(v, "$.centroid", "array<double>"), F.try_variant_get(v, "$.vector", "array<double>"))
    return _items(spark, path, "centroids", "datasets", "entries").select(_text(v, "dataset_id", "label", "id", "name").alias("label"), vector.alias("centroid")).where("centroid IS NOT NULL")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below a folder, hidden ones left out; an empty folder is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    if found.isEmpty():
        raise ValueError(f"no files in {path}")
    return found


def write_tags(tags: DataFrame, path: str, form: str = "json") -> None:
    """Tags as JSON lines or CSV."""
    (tags.write.mode("overwrite").json(path) if form == "json" else tags.write.mode("overwrite").option("header", True).csv(path))


def write_segments(segments: DataFrame, path: str) -> None:
    """One file a segment of (doc_id, number, text), in a folder a document; texts end in a line feed as they are written."""
    segments.select("doc_id", "number", "text").repartition("doc_id").write.mode("overwrite").partitionBy("doc_id", "number").text(path)


def write_artifacts(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as JSON lines below ``path``; (name, rows) of what was written."""
    spark, counts = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        counts.append((name, spark.read.text(f"{path}/{name}").count()))
    return spark.createDataFrame(counts, "name string, rows long")


def read_gate(spark: SparkSession, path: str) -> DataFrame:
    """Thresholds (metric, op, threshold) of ``min_x``, ``max_x`` and ``max_x_drop`` keys."""
    m = F.coalesce(F.from_json("value", "struct<thresholds:map<string,double>>")["thresholds"], F.from_json("value", "map<string,double>"))
    kv = _whole(spark, path).select(F.explode(m).alias("k", "threshold"))
    op = F.when(F.col("k").rlike("^max_.*_drop$"), "drop").when(F.col("k").startswith("max_"), "max").when(F.col("k").startswith("min_"), "min")
    return kv.select(F.regexp_replace("k", "^(min|max)_|_drop$", "").alias("metric"), op.alias("op"), "threshold").where("op IS NOT NULL")


def read_routing(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge bases (name, description, hints) of a routing table."""
    kb = "struct<name:string,description:string,hints:array<string>>"
    return _whole(spark, path).select(F.explode(_either("knowledge_bases", kb)).alias("k")).select("k.name", F.coalesce("k.description", F.lit("")).alias("description"), F.coalesce("k.hints", F.array().cast("array<string>")).alias("hints"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the .md and .markdown files below a folder."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown}").text(path, wholetext=True)
    return t.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(phase, ms) timings found in log lines such as ``parse: 12 ms`` or ``embed=3.5s``."""
    pattern = r"(?i)([a-z_]+)\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)\s*(ms|s)\b"
    g = lambda i: F.regexp_extract("value", pattern, i)
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(F.lower(g(1)).alias("phase"), (g(2).cast("double") * F.when(F.lower(g(3)) == "s", 1000).otherwise(1)).alias("ms"))
