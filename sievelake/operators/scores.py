"""Scores of profiles and experiment candidates, their order, ties and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the scores.
PROFILE_WEIGHTS = {"pass_rate": 0.38, "hit_rate": 0.25, "mrr": 0.20, "ndcg_at_k": 0.12, "empty_result_rate": -0.05}
CANDIDATE_WEIGHTS = {"pass_rate": 0.30, "hit_rate": 0.20, "mrr": 0.20, "ndcg_at_k": 0.15, "strict_chunk_recall_at_k": 0.10, "expected_chunk_hit_rate": 0.05, "empty_result_rate": -0.10}


def clamp(value: Column) -> Column:
    """A number between 0 and 1; 0 for a null."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(value.cast("double"), F.lit(0.0))))


def rate(part: Column, whole: Column) -> Column:
    """part / whole with 4 digits, 0 of nothing."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4)


def profile_scores(reports: DataFrame) -> DataFrame:
    """Score and penalties of validation reports: metrics (null is 0), query_latency_ms, cost_usd, query_count."""
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    quality = sum((value(c) * w for c, w in PROFILE_WEIGHTS.items()), F.lit(0.0))
    late = F.least(value("query_latency_ms") / 10000, F.lit(0.05))
    per_query = F.when((value("cost_usd") > 0) & (F.col("query_count") > 0), value("cost_usd") / F.col("query_count")).otherwise(0.0)
    dear = F.when((value("cost_usd") > 0) & (F.col("query_count") <= 0), F.least(value("cost_usd") * 0.1, F.lit(0.05))).otherwise(F.least(per_query * 20, F.lit(0.05)))
    scored = reports.withColumns({"latency_penalty": F.round(late, 6), "cost_penalty": F.round(dear, 6), "benchmark_quality": F.round((value("hit_rate") + value("mrr") + value("ndcg_at_k")) / 3, 6), "score": F.round(quality - late - dear, 6)})
    return scored.withColumn("place", F.rank().over(Window.orderBy(F.desc("score"))).cast("long"))


def profile_decision(scored: DataFrame, least_queries: int = 20, least_profiles: int = 2, least_delta: float = 0.03) -> DataFrame:
    """One row: the best profile, how far it leads, and whether that is enough to change the default."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "profile_id"))), 1, 2)
    d = scored.agg(F.count("*").alias("profiles"), F.max("query_count").alias("queries"), top.alias("t"))
    delta = F.round(-F.col("t")[0]["m"] + F.coalesce(F.get("t", F.lit(1))["m"], F.lit(0.0)), 6)
    few = (F.col("profiles") < least_profiles) | (F.col("queries") < least_queries)
    decision = F.when(few, "insufficient_sample_for_default_change").when(delta < least_delta, "tie_or_no_default_change").otherwise("recommend_default_change")
    return d.select("profiles", "queries", F.col("t")[0]["profile_id"].alias("winner"), delta.alias("score_delta"), decision.alias("status"))


def candidate_scores(results: DataFrame) -> DataFrame:
    """Scores of experiment candidates before and after costs: candidate_index, metrics, query_latency_ms, parse_time_ms, enrichment_weight.

    Costs are relative to the dearest candidate: latency and parse time up to 0.05 (0.025 where not
    observed), enrichment up to 0.04. The maxima are one row, sent to all.
    """
    maxima = results.agg(F.max("query_latency_ms").alias("_l"), F.max("parse_time_ms").alias("_p"), F.max("enrichment_weight").alias("_e"))
    before = F.greatest(F.lit(0.0), sum((clamp(F.col(c)) * w for c, w in CANDIDATE_WEIGHTS.items()), F.lit(0.0)))
    share = lambda c, m, most: F.when(F.col(m) > 0, F.least(F.lit(1.0), F.col(c) / F.col(m)) * most).otherwise(0.0)
    observed = lambda c, m: F.when(F.col(c).isNull(), 0.025).otherwise(share(c, m, 0.05))
    cost = F.round(observed("query_latency_ms", "_l"), 4) + F.round(observed("parse_time_ms", "_p"), 4) + F.round(share("enrichment_weight", "_e", 0.04), 4)
    j = results.join(F.broadcast(maxima), F.lit(True))
    return j.withColumns({"pre_cost_score": F.round(clamp(before), 4), "cost_penalty": F.round(cost, 4), "score": F.round(clamp(before - cost), 4)}).drop("_l", "_p", "_e")


def ranked(scored: DataFrame) -> DataFrame:
    """Place of each candidate: score, then least enrichment, latency, parse time (unknown last), index."""
    order = [F.desc("score"), "enrichment_weight", F.asc_nulls_last("query_latency_ms"), F.asc_nulls_last("parse_time_ms"), "candidate_index"]
    return scored.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def co_winners(placed: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """Candidates whose score before costs is that of the first, within ``epsilon``."""
    first = placed.where("place = 1").select(F.col("pre_cost_score").alias("_top"))
    return placed.join(F.broadcast(first), F.lit(True)).where(F.abs(F.col("pre_cost_score") - F.col("_top")) <= epsilon).drop("_top")


def saturation(results: DataFrame, metrics: tuple[str, ...] = ("hit_rate", "mrr", "recall_at_k")) -> DataFrame:
    """(metric, saturated): whether all of several candidates have one value."""
    one = [((F.count("*") > 1) & (F.count_distinct(F.coalesce(c, F.lit(0.0))) == 1)).alias(c) for c in metrics]
    return results.agg(*one).unpivot([], list(metrics), "metric", "saturated")


def decision(placed: DataFrame, strength: str, epsilon: float = 1e-9, least_delta: float = 0.0) -> DataFrame:
    """One row: co-winners, lead and status of an experiment whose benchmark has a strength."""
    winners = co_winners(placed, epsilon).agg(
        F.count("*").alias("co_winners"), F.max(((F.col("enrichment_weight") > 0) & (F.col("query_latency_ms").isNull() | F.col("parse_time_ms").isNull())).cast("int")).alias("unknown"),
        F.count_if((F.col("place") > 1) & F.col("query_latency_ms").isNotNull() & F.col("parse_time_ms").isNotNull()).alias("others"),
        F.min(F.when(F.col("place") > 1, F.when(F.col("parse_time_ms").isNotNull(), F.col("query_latency_ms")))).alias("l"), F.min(F.when(F.col("place") > 1, F.when(F.col("query_latency_ms").isNotNull(), F.col("parse_time_ms")))).alias("p"),
        F.max(F.when(F.col("place") == 1, F.col("query_latency_ms"))).alias("l1"), F.max(F.when(F.col("place") == 1, F.col("parse_time_ms"))).alias("p1"),
    )
    lead = placed.agg(F.round(F.max(F.when(F.col("place") == 1, F.col("score"))) - F.max(F.when(F.col("place") == 2, F.col("score"))), 4).alias("score_delta"))
    several = F.col("co_winners") > 1
    worse = (F.col("l1").isNotNull() & F.col("p1").isNotNull()) & ((F.col("l1") > F.col("l")) | (F.col("p1") > F.col("p")))
    review = several & ((F.col("unknown") > 0) | F.coalesce(worse, F.lit(False)))
    status = (
        F.when(F.col("co_winners") == 0, "insufficient_evidence").when(F.lit(strength in ("exploratory", "blocked")), "insufficient_evidence")
        .when(~several & (F.col("score_delta") < least_delta), "insufficient_evidence").when(review, "needs_cost_review").when(several, "co_winners").otherwise("recommended")
    )
    return winners.join(F.broadcast(lead), F.lit(True)).select("co_winners", "score_delta", status.alias("status"))


def top_k_candidates(k: Column) -> Column:
    """Larger cutoffs worth a try beside ``k``, sorted."""
    return F.array_sort(F.array_distinct(F.array(k, F.greatest(k + 1, F.ceil(k * 1.5)), F.least(F.greatest(k + 2, k * 2), F.lit(20)).cast("long"))))


def grid(values: dict[str, DataFrame], key: Column, most: int = 64) -> DataFrame:
    """All combinations of the values (one-column tables, small), the first of each ``key``, numbered; more than ``most`` are an error."""
    tables = list(values.values())
    out = tables[0]
    for t in tables[1:]:
        out = out.join(F.broadcast(t), F.lit(True))
    n = out.count()
    if n > most:
        raise ValueError(f"{n} combinations, {most} are allowed")
    order = Window.orderBy(*values)
    numbered = out.withColumn("i", F.row_number().over(order))
    return numbered.withColumn("first", F.min("i").over(Window.partitionBy(key))).where("i = first").drop("first")
