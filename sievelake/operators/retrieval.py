"""Lexical and vector retrieval, evidence weights, status, fusion and rerank comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import text as tx


def lexical_topk(docs: DataFrame, queries: DataFrame, k: int = 10, broadcast_terms: int = 1_000_000) -> DataFrame:
    """The ``k`` documents (doc_id, text) with most of each query's (query_id, question) tokens.

    The queries' terms, each with the queries that have it, go to the executors while they are few
    enough (else they are joined by a shuffle); documents keep only those terms. Scores are
    combined map-side, and each part of the documents offers its own best ``k`` of a query before
    the last ranking, so no query's candidates gather in one task. Returns query_id, doc_id,
    n_terms, similarity (share of the query's tokens, 6 digits), rank.
    """
    q = queries.select("query_id", tx.evidence_tokens(F.col("question")).alias("terms")).select("query_id", F.size("terms").cast("long").alias("n_terms"), F.explode("terms").alias("term"))
    of = q.groupBy("term").agg(F.collect_list(F.struct("query_id", "n_terms")).alias("of"))
    small = of.agg(F.sum(F.size("of"))).first()[0] or 0
    d = docs.select("doc_id", F.explode(tx.evidence_tokens(F.col("text"))).alias("term"))
    hits = d.join(F.broadcast(of) if small <= broadcast_terms else of, "term").select("doc_id", F.explode("of").alias("q"))
    hits = hits.groupBy("doc_id", "q.query_id", "q.n_terms").agg(F.count("*").alias("n"))
    scored = hits.select("query_id", "doc_id", "n_terms", F.round(F.col("n") / F.col("n_terms"), 6).alias("similarity"))
    order = [F.desc("similarity"), "doc_id"]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    offered = scored.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("r") <= k)
    return offered.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).where(F.col("rank") <= k).drop("part", "r")


def cosine_topk(vectors: DataFrame, centroids: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` centroids (label, centroid) nearest to each vector (vec_id, embedding) by cosine.

    One row per vector: candidates are scored inside an array, so vectors are not shuffled per
    pair. The centroid side is one row per label; it is gathered to one array.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    table = centroids.agg(F.collect_list(F.struct("label", "centroid", norm(F.col("centroid")).alias("norm"))).alias("all"))
    v = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).withColumn("n", norm(F.col("e")))
    score = lambda c: F.when((F.col("n") > 0) & (c["norm"] > 0), F.round(dot(F.col("e"), c["centroid"]) / (F.col("n") * c["norm"]), 6)).otherwise(0.0)
    ranked = F.slice(F.array_sort(F.transform("all", lambda c: F.struct((-score(c)).alias("m"), c["label"].alias("label")))), 1, k)
    out = v.crossJoin(F.broadcast(table)).select("vec_id", F.posexplode(ranked).alias("rank", "c"))
    return out.select("vec_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("c.label").cast("long").alias("label"), (-F.col("c.m")).alias("cosine"))


def evidence_weights(hits: DataFrame) -> DataFrame:
    """Score of each hit (query_id, rank, question, text, similarity): 4 digits of
    0.65 similarity + 0.25 coverage + 0.05 / rank. Hits here carry no keywords."""
    q, c = tx.evidence_tokens(F.col("question")), tx.evidence_tokens(F.col("text"))
    coverage = F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q)).otherwise(0.0)
    sim = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0))))
    return hits.withColumn("term_coverage", tx.round_half(coverage, 4)).withColumn("score", tx.round_half(sim * 0.65 + coverage * 0.25 + 0.05 / F.col("rank"), 4))


def retrieval_status(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """First fitting status of each query: empty, low_quality, needs_refinement, success."""
    top = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("similarity").alias("sim"), F.max("score").alias("ev"))
    status = F.when(F.col("n").isNull(), "empty").when((F.col("sim") < 0.15) & (F.col("ev") < 0.2), "low_quality").when(F.col("ev") < 0.2, "needs_refinement").otherwise("success")
    return queries.join(top, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_hits"), status.alias("status"))


def rrf_fuse(runs: DataFrame, k: int = 60, top: int = 10) -> DataFrame:
    """Reciprocal rank fusion of runs (source, query_id, doc_id, rank).

    A share 1 / (k + rank) is rounded to 6 digits, so sums of shares need no second rounding
    but for float noise. Order: score, best rank, id.
    """
    share = F.round(1 / (k + F.col("rank")), 6)
    fused = runs.groupBy("query_id", "doc_id").agg(F.round(F.sum(share), 6).alias("score"), F.min("rank").alias("best_rank"), F.count("*").alias("n_sources"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "doc_id")
    return fused.withColumn("fused_rank", F.row_number().over(order).cast("long")).where(F.col("fused_rank") <= top)


def minmax(runs: DataFrame, value: str = "similarity") -> DataFrame:
    """Value scaled to 0..1 within source and query; 1.0 where all are equal."""
    w = Window.partitionBy("source", "query_id")
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return runs.withColumn("normalized", F.when(hi == lo, 1.0).otherwise(F.round((F.col(value) - lo) / (hi - lo), 6)))


def rerank_compare(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """Per query: top-k overlap and mean absolute rank change of documents in both runs."""
    both = before.where(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("r0")).join(
        after.where(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("r1")), ["query_id", "doc_id"], "full")
    common: Column = F.col("r0").isNotNull() & F.col("r1").isNotNull()
    return both.groupBy("query_id").agg(
        F.count_if(common).alias("n_common"), F.count_if(common & (F.col("r1") < F.col("r0"))).alias("n_up"), F.count_if(common & (F.col("r1") > F.col("r0"))).alias("n_down"),
        F.round(F.count_if(common) / F.greatest(F.count("r0"), F.lit(1)), 6).alias("overlap"),
        F.round(F.coalesce(F.avg(F.abs(F.col("r1") - F.col("r0"))), F.lit(0.0)), 6).alias("mean_abs_delta"))
