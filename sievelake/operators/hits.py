"""Raw search answers as hits, and the status of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that a field of a raw hit may have, the first that is not empty wins.
ALIASES = {
    "content": ["content_with_weight", "content", "text", "page_content"],
    "document_name": ["docnm_kwd", "document_name", "document_keyword", "doc_name"],
    "document_id": ["doc_id", "document_id"],
    "dataset_id": ["kb_id", "dataset_id"],
    "chunk_id": ["id", "chunk_id"],
}
LISTS = ["chunks", "docs", "results"]
CLARIFICATION = ["clarification", "clarification_needed", "needs_clarification"]
REJECTION = ["rejected", "reject", "out_of_scope"]


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def first_string(v: Column, keys: list[str]) -> Column:
    """The first text among the fields that is not empty; values that are no texts are passed over."""
    found = [F.when(_kind(v, f"$.{k}") == "STRING", F.try_variant_get(v, f"$.{k}", "string")) for k in keys]
    return F.coalesce(*(F.when(x != "", x) for x in found))


def normalize(raw: DataFrame) -> DataFrame:
    """Hits of (query_id, response) JSON answers: a list, or an object with the list under data or at its top, as chunks, docs or results.

    Answers without a list give no rows. similarity stands in for score unless it is 0 or absent;
    a keyword text is a list of one.
    """
    v = F.try_parse_json("response")
    top = raw.select("query_id", v.alias("v")).select("query_id", "v", F.coalesce(F.try_variant_get("v", "$.data", "variant"), F.col("v")).alias("d"))
    listed = lambda path: F.try_variant_get("d", path, "array<variant>")
    lists = [F.when(F.size(listed(f"$.{k}")) > 0, listed(f"$.{k}")) for k in LISTS]
    items = F.coalesce(listed("$"), *lists, F.array().cast("array<variant>"))
    hit = top.select("query_id", F.posexplode(items).alias("i", "h")).where(F.schema_of_variant("h").startswith("OBJECT"))
    h = F.col("h")
    number = lambda k: F.try_variant_get(h, f"$.{k}", "double")
    words = lambda k: F.coalesce(F.try_variant_get(h, f"$.{k}", "array<string>"), F.when((_kind(h, f"$.{k}") == "STRING") & (F.trim(F.try_variant_get(h, f"$.{k}", "string")) != ""), F.array(F.trim(F.try_variant_get(h, f"$.{k}", "string")))))
    keywords = F.coalesce(F.when(F.size(words("important_keywords")) > 0, words("important_keywords")), words("important_kwd"), F.array().cast("array<string>"))
    return hit.select(
        "query_id", (F.col("i") + 1).cast("long").alias("rank"), F.coalesce(first_string(h, ALIASES["content"]), F.lit("")).alias("content"),
        F.coalesce(F.when(number("similarity") != 0, number("similarity")), number("score")).alias("similarity"),
        *(first_string(h, names).alias(c) for c, names in ALIASES.items() if c != "content"), keywords.alias("important_keywords"),
    )


def status(n_hits: Column, similarity: Column, evidence: Column, intent: Column, error: Column, timed_out: Column, partial: Column, least_similarity: float = 0.15, least_evidence: float = 0.2) -> Column:
    """The first that fits of nine: clarification, rejected, timeout, error, partial, empty, low_quality, needs_refinement, success."""
    wish, text = F.lower(F.trim(F.coalesce(intent, F.lit("")))), F.lower(F.coalesce(error, F.lit("")))
    late = F.coalesce(timed_out, F.lit(False)) | text.contains("timed out") | text.contains("timeout")
    weak = evidence.isNull() | (evidence < least_evidence)
    return (
        F.when(wish.isin(CLARIFICATION), "clarification").when(wish.isin(REJECTION), "rejected").when(late, "timeout").when(error.isNotNull(), "error")
        .when(F.coalesce(partial, F.lit(False)), "partial").when(F.coalesce(n_hits, F.lit(0)) == 0, "empty")
        .when((similarity < least_similarity) & weak, "low_quality").when(evidence < least_evidence, "needs_refinement").otherwise("success")
    )
