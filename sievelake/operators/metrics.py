"""Ranking metrics, their averages, gates and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def query_metrics(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """hit, mrr, precision, recall, ndcg and map at ``k`` of each query with a positive qrel.

    hits: query_id, doc_id, rank; qrels: query_id, doc_id, relevance. P@k divides by k; MAP by
    the number of relevant targets; the gain is 2^rel - 1 over log2(rank + 1).
    """
    rel = qrels.where("relevance > 0").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("rel"))
    gain = lambda c: F.pow(F.lit(2.0), c) - 1
    ideal = rel.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))).groupBy("query_id").agg(
        F.count("*").alias("n_rel"), F.sum(F.when(F.col("i") <= k, gain(F.col("rel")) / F.log2(F.col("i") + 1))).alias("ideal"))
    found = hits.where(F.col("rank") <= k).join(rel, ["query_id", "doc_id"])
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    got = found.groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("rank").alias("first"), F.sum(gain(F.col("rel")) / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("nth") / F.col("rank")).alias("ap"))
    n = F.coalesce("n", F.lit(0))
    r6 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return ideal.join(got, "query_id", "left").select(
        "query_id", (n > 0).cast("double").alias("hit"), r6(1 / F.col("first")).alias("mrr"), r6(n / k).alias("precision"), r6(n / F.col("n_rel")).alias("recall"),
        r6(F.col("dcg") / F.col("ideal")).alias("ndcg"), r6(F.col("ap") / F.col("n_rel")).alias("map"))


NAMES = ["hit", "mrr", "precision", "recall", "ndcg", "map"]


def macro_average(per_query: DataFrame) -> DataFrame:
    """Mean of every metric over the queries, and their count."""
    return per_query.agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 6).alias(c) for c in NAMES))


def unpivot(metrics: DataFrame) -> DataFrame:
    return metrics.unpivot([], NAMES, "metric", "actual")


def gate(metrics: DataFrame, thresholds: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """Checks of (metric, actual) against (metric, op, threshold); a null on either side gives no check.

    ``min`` passes from the threshold up, ``max`` down to it. ``drop`` looks at the metric's change
    (the ``absolute`` of ``deltas``) and passes from -threshold up; without ``deltas`` it is not checked.
    """
    change = metrics.select("metric", F.lit(None).cast("double").alias("absolute")) if deltas is None else deltas.select("metric", "absolute")
    j = thresholds.join(metrics, "metric", "left").join(change, "metric", "left")
    j = j.withColumn("actual", F.when(F.col("op") == "drop", F.col("absolute")).otherwise(F.col("actual"))).drop("absolute")
    ok = F.when(F.col("op") == "min", F.col("actual") >= F.col("threshold")).when(F.col("op") == "max", F.col("actual") <= F.col("threshold")).otherwise(F.col("actual") >= -F.col("threshold"))
    return j.where("actual IS NOT NULL AND threshold IS NOT NULL").withColumn("passed", ok)


def metric_delta(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Absolute and relative change of metrics both runs have, and its direction."""
    j = current.select("metric", F.col("actual").alias("now")).join(baseline.select("metric", F.col("actual").alias("then")), "metric")
    d = F.round(F.col("now") - F.col("then"), 6)
    return j.select("metric", d.alias("absolute"), F.when(F.col("then") != 0, F.round(d / F.abs("then"), 6)).alias("relative"),
                    F.when(d > 0, "up").when(d < 0, "down").otherwise("same").alias("direction"))
