"""States of documents in a remote index, matched to a manifest; warnings on slow or large runs; retries, rate limits and circuit breakers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of states and thresholds.
SUCCEEDED = ["done", "success", "completed", "parsed", "finish", "finished", "1"]
FAILED = ["fail", "failed", "error", "cancelled", "canceled", "-1"]
IMAGE_SUFFIX = r"(?i)\.(png|jpg|jpeg|gif|webp|bmp|tif|tiff)$"
SLOW_PARSE_MS, SLOW_VISUAL_MS = 60_000.0, 30_000.0
MANY_CHUNKS, MANY_CHUNKS_OF_ONE, NEAR_TIMEOUT = 10_000, 1_000, 0.8
PARSE_PHASES = ["parse", "parser", "chunk", "embedding", "embed"]
VISUAL_PHASES = ["image", "vision", "ocr", "layout", "table"]


def _low(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def tells_failure(message: Column) -> Column:
    return F.lower(F.coalesce(message, F.lit(""))).rlike(r"\[error\]|exception|fail")


def effective_state(run: Column, status: Column, progress: Column, message: Column) -> Column:
    """The run's state, else what a finished or negative progress, the message, or the status says; else 'pending'."""
    number = progress.cast("string").try_cast("double")
    return (
        F.when(_low(run) != "", _low(run)).when(number >= 1, "1").when(number < 0, "-1").when(tells_failure(message), "failed")
        .when(_low(status) != "", _low(status)).when(_low(progress) != "", _low(progress)).otherwise("pending")
    )


def has_failed(state: Column, progress: Column, message: Column) -> Column:
    return state.isin(FAILED) | F.coalesce(progress.cast("string").try_cast("double") < 0, F.lit(False)) | tells_failure(message)


def has_succeeded(state: Column, progress: Column, message: Column) -> Column:
    return state.isin(SUCCEEDED) & ~has_failed(state, progress, message)


def document_kind(name: Column, mime: Column) -> Column:
    """image, markdown, text or other, by media type and suffix."""
    kind, file = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(kind.startswith("image/") | file.rlike(IMAGE_SUFFIX), "image").when(file.rlike(r"\.(md|markdown)$") | kind.isin("text/markdown", "text/x-markdown"), "markdown")
        .when(kind.startswith("text/"), "text").otherwise("other")
    )


def match_status(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Each manifest row (document_id, path) with the state of its id (the last row's), else of its path or file name (the first row's).

    observed: pos, document_id, name, state. Each lookup is one row a key, so no join multiplies rows.
    """
    base = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)
    by_id = observed.where("document_id <> ''").groupBy("document_id").agg(F.max_by("state", "pos").alias("s_id"))
    keys = observed.select("pos", "state", F.explode(F.array_distinct(F.array("name", base("name")))).alias("key")).where("key <> ''")
    by_name = keys.groupBy("key").agg(F.min_by("state", "pos").alias("s"))
    j = manifest.join(by_id, "document_id", "left")
    j = j.join(by_name.select(F.col("key").alias("path"), F.col("s").alias("s_path")), "path", "left")
    j = j.withColumn("_base", base("path")).join(by_name.select(F.col("key").alias("_base"), F.col("s").alias("s_base")), "_base", "left")
    return j.select("document_id", "path", F.coalesce("s_id", "s_path", "s_base").alias("state"))


def phase_warning(phase: Column, ms: Column) -> Column:
    """Code of a phase that took too long; else null."""
    name = _low(phase)
    return F.when(name.isin(VISUAL_PHASES) & (ms >= SLOW_VISUAL_MS), "slow_image_vlm_processing").when(name.isin(PARSE_PHASES) & (ms >= SLOW_PARSE_MS), "slow_parse_phase")


def stage_warning(ms: Column, visual: Column) -> Column:
    return F.when(visual & (ms >= SLOW_VISUAL_MS), "slow_image_vlm_processing").when(~visual & (ms >= SLOW_PARSE_MS), "slow_parse_phase")


def chunk_warnings(documents: DataFrame) -> DataFrame:
    """(document_id, code, chunk_count) of documents with many chunks, and of all together (a null id)."""
    one = documents.where(F.col("chunk_count") >= MANY_CHUNKS_OF_ONE).select("document_id", F.lit("high_document_chunk_count").alias("code"), "chunk_count")
    total = documents.agg(F.sum("chunk_count").alias("chunk_count")).where(F.col("chunk_count") >= MANY_CHUNKS)
    return one.unionByName(total.select(F.lit(None).cast(documents.schema["document_id"].dataType).alias("document_id"), F.lit("high_total_chunk_count").alias("code"), "chunk_count"))


def polling_warning(timeout_s: Column, elapsed_ms: Column, pending: Column) -> Column:
    """Whether a wait ended near its timeout."""
    return F.coalesce(F.when(timeout_s <= 0, pending > 0).otherwise(elapsed_ms / (timeout_s * 1000) >= NEAR_TIMEOUT), F.lit(False))


def retry_delays(attempts: Column, first_s: float, factor: float, most_s: float) -> Column:
    """Seconds to wait before each further attempt, growing by a factor up to a limit."""
    return F.when(attempts > 1, F.transform(F.sequence(F.lit(0), attempts - 2), lambda i: F.round(F.least(F.lit(most_s), first_s * F.pow(F.lit(factor), i)), 3))).otherwise(F.array().cast("array<double>"))


def rate_limit(requests: DataFrame, rate: float, burst: int) -> DataFrame:
    """Delay in ms of each request (key, at: seconds) under a token bucket a key; requests of a key are taken in order of time."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", kind="stable")
        tokens, last, out = float(burst), None, []
        for at in rows["at"]:
            if last is not None and at > last:
                tokens = min(float(burst), tokens + (at - last) * rate)
            last = at if last is None else max(last, at)
            wait = 0.0 if tokens >= 1 else (1 - tokens) / rate
            tokens = tokens - 1 if tokens >= 1 else 0.0
            last += wait
            out.append(round(wait * 1000, 3))
        return rows.assign(delay_ms=out)[["key", "at", "delay_ms"]]

    return requests.select("key", F.col("at").cast("double").alias("at")).groupBy("key").applyInPandas(one, requests.select("key").schema.add("at", "double").add("delay_ms", "double"))


def circuit(requests: DataFrame, threshold: int, recovery_s: float, failures: list[str]) -> DataFrame:
    """Whether each request (key, at: seconds, status) may run, and the breaker's state after it.

    ``threshold`` failures one after another open it; after ``recovery_s`` it is half open; then
    a success closes it and a failure opens it again. Requests while it is open do not run.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.sort_values("at", kind="stable")
            state, failed, opened, out = "closed", 0, 0.0, []
            for at, status in zip(part["at"], part["status"], strict=True):
                if state == "open" and at - opened >= recovery_s:
                    state = "half_open"
                allowed = state != "open"
                if allowed and status in failures:
                    failed += 1
                    if failed >= threshold:
                        state, opened = "open", at
                elif allowed:
                    failed = 0
                    state = "closed"
                out.append((allowed, state))
            yield part[["key", "at", "status"]].assign(allowed=[a for a, _ in out], state=[s for _, s in out])

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return next(rows(iter([part])))

    schema = requests.select("key").schema.add("at", "double").add("status", "string").add("allowed", "boolean").add("state", "string")
    return requests.select("key", F.col("at").cast("double").alias("at"), "status").groupBy("key").applyInPandas(one, schema)
