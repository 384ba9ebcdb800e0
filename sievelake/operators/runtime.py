"""Latency summaries, stage counts and outcomes of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latency_summary(events: DataFrame, by: str = "event_type", value: str = "value", parts: int = 256) -> DataFrame:
    """min, max, average and nearest-rank p50, p95, p99 of finite samples from 0 up, 3 digits.

    Exact ranks without a group in one task: values are counted once each (combined map-side), the
    counts of each group are summed by buckets of even width between its bounds, and of each rank
    only the bucket that holds it is looked at value by value.
    """
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) >= 0) & (F.col(value) < float("inf"))
    c = events.where(ok).groupBy(F.col(by).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    bounds = c.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(parts - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts))).otherwise(0).cast("int").alias("b")
    same = F.col("c.k").eqNullSafe(F.col("g.k"))
    placed = c.alias("c").join(bounds.alias("g"), same).select("c.k", "v", "c", "lo", "hi", "n", "s", place)
    buckets = placed.groupBy("k", "b").agg(F.sum("c").alias("in_b"), F.first("n").alias("n"))
    upto = buckets.withColumn("before", F.sum("in_b").over(Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_b"))
    ranks = upto.select("k", "b", "before", "in_b", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.ceil(F.lit(p) * F.col("n") / 100).alias("r")) for p in (50, 95, 99)))).alias("q"))
    wanted = ranks.where("q.r > before AND q.r <= before + in_b").select("k", "b", "before", "q.p", "q.r")
    own = placed.alias("x").join(wanted.alias("w"), F.col("x.k").eqNullSafe(F.col("w.k")) & (F.col("x.b") == F.col("w.b"))).select("x.k", "v", "c", "before", "p", "r")
    run = own.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("k", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    at = run.where("upto >= r").groupBy("k").agg(*(F.round(F.min(F.when(F.col("p") == p, F.col("v"))), 3).alias(f"p{p}") for p in (50, 95, 99)))
    out = bounds.alias("g").join(at.alias("a"), F.col("g.k").eqNullSafe(F.col("a.k")))
    return out.select(F.col("g.k").alias(by), F.col("n").alias("sample_count"), F.round("lo", 3).alias("minimum"), F.round("hi", 3).alias("maximum"), F.round(F.col("s") / F.col("n"), 3).alias("average"), "p50", "p95", "p99")


def stage_summary(events: DataFrame) -> DataFrame:
    """Counts and totals by event type, and over all of them, in one pass of grouping sets."""
    return events.rollup("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.coalesce("event_type", F.lit("all")).alias("stage"), "n", "total")


def outcome(items: DataFrame, key: str, status: str, success: list[str], warning: list[str], failure: list[str], skipped: list[str], timeout: list[str] | None = None) -> DataFrame:
    """Outcome of each key from the statuses of its items; the first fitting of eight, 'empty' being that of no items at all.

    A success beside a failed, skipped or timed-out item is partial.
    """
    kinds = {"ok": success, "warned": warning, "failed": failure, "skipped": skipped, "late": timeout or []}
    n = {k: F.count_if(F.coalesce(status, F.lit("unknown")).isin(v)).alias(k) for k, v in kinds.items()}
    known = F.count_if(F.coalesce(status, F.lit("unknown")).isin([*success, *warning, *failure, *skipped])).alias("known")
    c = items.groupBy(key).agg(F.count("*").alias("n"), known, *n.values()).withColumn("unknown", F.expr("n - known"))
    s = (F.when(F.expr("n = 0"), "empty").when(F.expr("ok > 0 AND failed + skipped + late > 0"), "partial").when(F.col("failed") > 0, "failed").when(F.expr("skipped = n"), "skipped")
         .when(F.col("skipped") > 0, "incomplete").when(F.col("unknown") > 0, "unknown").when(F.col("warned") > 0, "completed_with_warnings").otherwise("completed"))
    return c.select(key, "n", s.alias("outcome"))


# Names of stages, with the standard stage and the category of each.
STAGE_NAMES = {
    "conversion": ("conversion", "conversion"),
    "convert": ("conversion", "conversion"),
    "document_conversion": ("conversion", "conversion"),
    "mineru_conversion": ("conversion", "conversion"),
    "backend_conversion": ("conversion", "conversion"),
    "postprocess": ("postprocess", "conversion"),
    "post_process": ("postprocess", "conversion"),
    "postprocessing": ("postprocess", "conversion"),
    "package": ("packaging", "conversion"),
    "packaging": ("packaging", "conversion"),
    "rich_handoff_package": ("packaging", "conversion"),
    "formal_handoff_manifest": ("packaging", "conversion"),
    "hints": ("hint_generation", "conversion"),
    "hint_generation": ("hint_generation", "conversion"),
    "retrieval_hints": ("hint_generation", "conversion"),
    "asset": ("asset_planning", "conversion"),
    "asset_upload_plan": ("asset_planning", "kb_build"),
    "asset_planning": ("asset_planning", "kb_build"),
    "ingest_plan": ("asset_planning", "kb_build"),
    "local_asset_copy": ("asset_planning", "conversion"),
    "remote_asset_materialization": ("asset_planning", "conversion"),
    "dataset_create": ("dataset_create", "kb_build"),
    "create_dataset": ("dataset_create", "kb_build"),
    "dataset_update": ("dataset_update", "kb_build"),
    "update_dataset": ("dataset_update", "kb_build"),
    "markdown_upload": ("markdown_upload", "kb_build"),
    "upload_markdown": ("markdown_upload", "kb_build"),
    "image_upload": ("image_upload", "kb_build"),
    "visual_upload": ("image_upload", "kb_build"),
    "trigger_parse": ("parse_trigger", "kb_build"),
    "parse_trigger": ("parse_trigger", "kb_build"),
    "wait_parse": ("parse_wait", "kb_build"),
    "parse_wait": ("parse_wait", "kb_build"),
    "image_parse_wait": ("parse_wait", "kb_build"),
    "validation": ("validation", "validation"),
    "validate": ("validation", "validation"),
    "benchmark_validation": ("validation", "validation"),
    "query": ("query", "query"),
    "ask": ("query", "query"),
    "retrieval": ("retrieval", "query"),
    "retrieve": ("retrieval", "query"),
    "cleanup": ("cleanup", "cleanup"),
    "cleanup_plan": ("cleanup", "cleanup"),
    "preview_cleanup_plan": ("cleanup", "cleanup"),
    "delete_dataset": ("cleanup", "cleanup"),
}


def standard_stage(stage: Column, operation: Column) -> Column:
    """struct(stage, category): the standard stage that the stage's name, else the operation's, stands for; else its own name and 'other'."""
    key = lambda c: F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "- ", "__")
    pair = lambda a, b: F.struct(a.alias("stage"), b.alias("category"))
    known = F.create_map(*(x for name, (a, b) in STAGE_NAMES.items() for x in (F.lit(name), pair(F.lit(a), F.lit(b)))))
    own = pair(F.when(key(stage) != "", key(stage)).otherwise("unspecified"), F.lit("other"))
    return F.coalesce(F.element_at(known, key(stage)), F.element_at(known, key(operation)), own)


def normalize_timings(timings: DataFrame) -> DataFrame:
    """(stage, operation, status, duration_ms, included_in) timings with their standard stage and category.

    A retrieval that is part of a query counts as the query; durations that are negative or not finite are null
    and do not count toward the total.
    """
    stage = F.coalesce(F.when(F.trim("stage") != "", F.trim("stage")), F.lit("unspecified"))
    operation = F.coalesce(F.when(F.trim("operation") != "", F.trim("operation")), stage)
    s = standard_stage(stage, operation)
    name = F.when((s["stage"] == "retrieval") & (F.trim(F.coalesce("included_in", F.lit(""))) == "query"), "query").otherwise(s["stage"])
    ms = F.when((F.col("duration_ms") >= 0) & ~F.isnan("duration_ms") & (F.col("duration_ms") < float("inf")), F.round("duration_ms", 3))
    return timings.withColumns({"standard_stage": name, "category": s["category"], "status": F.coalesce("status", F.lit("unknown")), "duration_ms": ms, "counted": ms.isNotNull()})
