"""Benchmark metrics of ranked hits against graded judgments: ranking, strict chunks, terms, documents, tags, modalities; averages and gates.

cases: query_id, query_type, expected_modalities, expected_terms, expected_documents,
expected_tags, allowed_tags (arrays), min_chunks. hits: query_id, rank, content, document_name,
document_id, chunk_id, tags (array), modality (a label). qrels: query_id, ord, field, target,
relevance. All joins are on query_id; the match of a target is checked inside the pair.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import labels as lb
from sievelake.functions import text as tx

CHUNK_FIELDS = ["expected_chunk", "chunk_hash", "chunk_id"]
DOCUMENT_FIELDS = ["document", "document_name", "document_id"]
#: Metrics that all queries have.
BASE = ["hit_rate", "mrr", "precision_at_k", "recall_at_k", "ndcg_at_k", "map_at_k", "empty_result_rate", "supporting_document_coverage"]
#: Metrics that only some queries have; averages leave out the others.
OPTIONAL = [
    "strict_chunk_recall_at_k", "expected_chunk_hit_rate", "expected_evidence_rank", "expected_term_recall_at_k", "expected_term_hit_rate",
    "table_term_recall_at_k", "table_term_hit_rate", "wrong_document_rate", "expected_tag_hit_rate", "tag_pollution_rate", "unexpected_tag_hit_rate",
    "image_precision_at_k", "image_recall_at_k", "visual_coverage", "table_recall_at_k",
]
COUNTS = ["expected_chunk_count", "matched_expected_chunks", "expected_term_count", "matched_expected_terms", "document_scored_chunk_count", "wrong_document_count",
          "expected_tag_count", "matched_expected_tags", "tagged_chunk_count", "polluted_tagged_chunk_count"]


def hit_references() -> Column:
    """All spellings of a hit's chunk: its id and the hash of its content."""
    return F.array_union(lb.references(F.col("chunk_id")), lb.references(lb.chunk_hash(F.col("content"))))


def matches() -> Column:
    """Whether a judgment (field, target) speaks of a hit."""
    field, target = F.col("field"), F.col("target")
    name, ident, chunk = (lb.target_matches(F.col(c), target) for c in ("document_name", "document_id", "chunk_id"))
    return (
        F.when(field == "chunk_id", chunk).when(field.isin("chunk_hash", "expected_chunk"), F.arrays_overlap(hit_references(), lb.references(target)))
        .when(field == "document_id", ident).when(field == "document_name", name).when(field == "content", lb.target_matches(F.col("content"), target))
        .otherwise(name | ident | chunk)
    )


def _prepared(qrels: DataFrame) -> DataFrame:
    """Positive judgments with their key, and whether they count for the ranking: those on chunks only where there are no others."""
    chunky = F.col("field").isin(CHUNK_FIELDS)
    plain = F.max((~chunky).cast("int")).over(Window.partitionBy("query_id")) > 0
    return qrels.where("relevance > 0").select(
        "*", F.lower(F.concat("field", F.lit(":"), "target")).alias("key"), chunky.alias("chunky"), (~chunky | ~plain).alias("ranks"),
    )


def best_judgments(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, rank, key, relevance, modality): of each hit the matching judgment of highest relevance, the first of equals."""
    pairs = hits.join(qrels, "query_id").where(matches())
    best = F.max_by(F.struct("key", "relevance"), F.struct("relevance", (-F.col("ord")).alias("o")))
    kind = lb.hit_modality(F.col("modality"), F.col("document_name"), F.col("content"))
    return pairs.withColumn("kind", kind).groupBy("query_id", "rank").agg(best.alias("b"), F.first("kind").alias("modality")).select("query_id", "rank", "b.*", "modality")


def _gain(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)


def _ranking(top: DataFrame, rel: DataFrame, k: int) -> DataFrame:
    best = best_judgments(top, rel.where("ranks"))
    keys = rel.where("ranks").groupBy("query_id", "key").agg(F.max("relevance").alias("rel"))
    place = Window.partitionBy("query_id")
    ideal = keys.withColumn("i", F.row_number().over(place.orderBy(F.desc("rel"), "key"))).groupBy("query_id").agg(
        F.count("*").alias("relevant_targets"), F.sum(F.when(F.col("i") <= k, _gain(F.col("rel"), F.col("i")))).alias("ideal"))
    found = best.groupBy("query_id", "key").agg(F.min("rank").alias("rank")).join(keys, ["query_id", "key"])
    found = found.withColumn("nth", F.row_number().over(place.orderBy("rank")))
    got = found.groupBy("query_id").agg(
        F.count("*").alias("matched_targets"), F.min("rank").alias("first_relevant_rank"),
        F.sum(_gain(F.col("rel"), F.col("rank"))).alias("dcg"), F.sum(F.col("nth") / F.col("rank")).alias("ap"),
    )
    seen = best.groupBy("query_id").agg(
        *(F.count_distinct(F.when(F.col("modality") == m, F.col("key"))).alias(f"matched_{m}_targets") for m in ("image", "table")))
    return ideal.join(got, "query_id", "left").join(seen, "query_id", "left")


def _strict(top: DataFrame, rel: DataFrame) -> DataFrame:
    refs = F.array_sort(lb.references(F.col("target")))
    key = F.coalesce(F.get(F.filter(refs, lambda x: x.startswith("sha256:")), F.lit(0)), F.get(refs, F.lit(0)), F.col("key"))
    wanted = rel.where("chunky").select("query_id", "ord", "target", key.alias("chunk_key"))
    hit = top.join(wanted, "query_id").where(F.arrays_overlap(hit_references(), lb.references(F.col("target"))))
    hit = hit.groupBy("query_id", "rank").agg(F.min_by("chunk_key", "ord").alias("chunk_key"))
    got = hit.groupBy("query_id").agg(F.count_distinct("chunk_key").alias("matched_expected_chunks"), F.min("rank").alias("expected_rank"))
    return wanted.groupBy("query_id").agg(F.count_distinct("chunk_key").alias("expected_chunk_count")).join(got, "query_id", "left")


def _documents(top: DataFrame, rel: DataFrame, cases: DataFrame) -> DataFrame:
    """Wrong hits among those that name their document, of queries that expect documents."""
    named = top.where("coalesce(document_name, '') <> '' OR coalesce(document_id, '') <> ''")
    right = named.join(rel.where(F.col("field").isin(DOCUMENT_FIELDS)).select("query_id", "field", "target", "chunky"), "query_id")
    either = lb.target_matches(F.col("document_name"), F.col("target")) | lb.target_matches(F.col("document_id"), F.col("target"))
    right = right.where(F.when(F.col("field") == "document", either).otherwise(matches())).select("query_id", "rank")
    listed = named.join(cases.select("query_id", F.explode("expected_documents").alias("target")), "query_id").where(either).select("query_id", "rank")
    judged = named.select("query_id", "rank").join(right.unionByName(listed).distinct().withColumn("right", F.lit(1)), ["query_id", "rank"], "left")
    return judged.groupBy("query_id").agg(F.count("*").alias("document_scored_chunk_count"), F.count_if(F.col("right").isNull()).alias("wrong_document_count"))


def judge(hits: DataFrame, qrels: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """All metrics of each query that has a positive judgment; those that a query does not define are null.

    The hits up to the cutoff (``k`` rows a query) and the judgments are read by several joins, so
    the session's cache keeps them, on disk where memory is short; lost parts are made again.
    """
    rel = _prepared(qrels).persist(StorageLevel.MEMORY_AND_DISK)
    hits = hits.persist(StorageLevel.MEMORY_AND_DISK)
    top = hits.where(F.col("rank") <= k)
    own = rel.groupBy("query_id").agg(F.max(F.col("field").isin(DOCUMENT_FIELDS)).alias("on_documents"))
    kind = lb.hit_modality(F.col("modality"), F.col("document_name"), F.col("content"))
    text = tx.collapse(F.lower(F.concat_ws("\n", "content", "document_name", "document_id")))
    low = lambda a: F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))
    per_hit = top.select("query_id", "rank", text.alias("text"), kind.alias("kind"), low(F.col("tags")).alias("tags"))
    shown = per_hit.groupBy("query_id").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])).alias("text"),
        F.collect_list("tags").alias("tag_sets"), *(F.count_if(F.col("kind") == m).alias(f"{m}_result_count") for m in ("image", "table")),
    )
    j = cases.join(own, "query_id").join(_ranking(top, rel, k), "query_id").join(_strict(top, rel), "query_id", "left")
    j = j.join(_documents(top, rel, cases), "query_id", "left").join(shown, "query_id", "left")
    j = j.join(hits.select("query_id").distinct().withColumn("any", F.lit(1)), "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    terms = F.filter("expected_terms", lambda t: F.trim(t) != "")
    met = F.filter(terms, lambda t: F.contains(F.coalesce("text", F.lit("")), tx.collapse(F.lower(F.trim(t)))))
    expected, allowed = low(F.col("expected_tags")), F.array_union(low(F.col("allowed_tags")), low(F.col("expected_tags")))
    tagged = F.filter(F.coalesce("tag_sets", F.array().cast("array<array<string>>")), lambda t: F.size(t) > 0)
    polluted = F.filter(tagged, lambda t: F.size(F.array_except(t, allowed)) > 0)
    retrieved = F.array_distinct(F.flatten(tagged))
    scoped = F.col("on_documents") | (F.size("expected_documents") > 0)
    asks = lambda m: F.array_contains("expected_modalities", m)
    n_terms, n_met = F.size(terms), F.size(met)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    strict = F.col("expected_chunk_count") > 0
    value = {
        "hit_rate": (zero("matched_targets") > 0).cast("double"), "mrr": F.coalesce(1 / F.col("first_relevant_rank"), F.lit(0.0)),
        "precision_at_k": zero("matched_targets") / k, "recall_at_k": zero("matched_targets") / F.col("relevant_targets"),
        "ndcg_at_k": F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)), "map_at_k": F.coalesce(F.col("ap"), F.lit(0.0)) / F.col("relevant_targets"),
        "empty_result_rate": F.col("any").isNull().cast("double"), "supporting_document_coverage": zero("matched_targets") / F.col("relevant_targets"),
        "strict_chunk_recall_at_k": F.when(strict, zero("matched_expected_chunks") / F.col("expected_chunk_count")),
        "expected_chunk_hit_rate": F.when(strict, (zero("matched_expected_chunks") > 0).cast("double")),
        "expected_evidence_rank": F.when(strict, F.coalesce("expected_rank", F.lit(k + 1)).cast("double")),
        "expected_term_recall_at_k": F.when(n_terms > 0, n_met / n_terms), "expected_term_hit_rate": F.when(n_terms > 0, (n_met == n_terms).cast("double")),
        "table_term_recall_at_k": F.when((n_terms > 0) & asks("table"), n_met / n_terms), "table_term_hit_rate": F.when((n_terms > 0) & asks("table"), (n_met == n_terms).cast("double")),
        "wrong_document_rate": F.when(scoped, share(zero("wrong_document_count"), zero("document_scored_chunk_count"))),
        "expected_tag_hit_rate": F.when(F.size(expected) > 0, F.size(F.array_intersect(retrieved, expected)) / F.size(expected)),
        "tag_pollution_rate": F.when(F.size(allowed) > 0, share(F.size(polluted), F.size(tagged))),
        "unexpected_tag_hit_rate": F.when(F.size(allowed) > 0, (F.size(F.array_except(retrieved, allowed)) > 0).cast("double")),
        "image_precision_at_k": F.when(asks("image"), zero("matched_image_targets") / k), "image_recall_at_k": F.when(asks("image"), zero("matched_image_targets") / F.col("relevant_targets")),
        "visual_coverage": F.when(asks("image"), (zero("image_result_count") > 0).cast("double")),
        "table_recall_at_k": F.when(asks("table"), zero("matched_table_targets") / F.col("relevant_targets")),
    }
    count = {
        "expected_chunk_count": F.col("expected_chunk_count"), "matched_expected_chunks": F.when(strict, zero("matched_expected_chunks")),
        "expected_term_count": F.when(n_terms > 0, n_terms), "matched_expected_terms": F.when(n_terms > 0, n_met),
        "document_scored_chunk_count": F.when(scoped, zero("document_scored_chunk_count")), "wrong_document_count": F.when(scoped, zero("wrong_document_count")),
        "expected_tag_count": F.when(F.size(expected) > 0, F.size(expected)), "matched_expected_tags": F.when(F.size(expected) > 0, F.size(F.array_intersect(retrieved, expected))),
        "tagged_chunk_count": F.when(F.size(allowed) > 0, F.size(tagged)), "polluted_tagged_chunk_count": F.when(F.size(allowed) > 0, F.size(polluted)),
    }
    return j.select("query_id", "query_type", *(F.round(v, 6).alias(c) for c, v in value.items()), *(v.cast("long").alias(c) for c, v in count.items()))


def averages(judged: DataFrame, by_type: bool = False) -> DataFrame:
    """Means of all metrics over the queries that define them, sums of the counts; with ``by_type`` a row a query type, and one for 'all'."""
    means = [F.round(F.avg(c), 6).alias(c) for c in BASE + OPTIONAL] + [F.sum(c).alias(c) for c in COUNTS]
    means += [F.count("expected_term_recall_at_k").alias("expected_term_query_count"), F.count("tag_pollution_rate").alias("tag_scope_query_count"), F.count("wrong_document_rate").alias("document_scope_query_count")]
    if by_type:
        rolled = judged.rollup("query_type").agg(F.count("*").alias("query_count"), *means)
        return rolled.withColumn("query_type", F.coalesce("query_type", F.lit("all")))
    return judged.agg(F.count("*").alias("query_count"), *means)


def long_metrics(means: DataFrame) -> DataFrame:
    """(metric, actual) of one row of averages."""
    return means.select(*(F.col(c).cast("double").alias(c) for c in BASE + OPTIONAL)).unpivot([], BASE + OPTIONAL, "metric", "actual")


def gate_report(checks: DataFrame) -> DataFrame:
    """One row for (metric, passed) checks: their number, those failed, and the status; without checks it passes."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("metric"))))
    return checks.agg(F.count("*").alias("checks"), failed.alias("failed_metrics"), F.coalesce(F.every("passed"), F.lit(True)).alias("ok")).withColumn("status", F.when(F.col("ok"), "passed").otherwise("failed"))


def validate(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Whether each case has enough hits, all its terms in their texts, and all its documents among them."""
    text = F.lower(F.concat_ws("\n", F.coalesce("content", F.lit("")), F.coalesce("document_name", F.lit("")), F.coalesce("document_id", F.lit(""))))
    names = F.lower(F.concat_ws("\n", "document_name", "document_id"))
    joined = lambda c: F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", c.alias("t")))), lambda x: x["t"]))
    shown = hits.groupBy("query_id").agg(F.count("*").alias("n"), joined(text).alias("text"), joined(names).alias("names"))
    j = cases.join(shown, "query_id", "left")
    missing = lambda a, c: F.filter(a, lambda x: ~F.contains(F.coalesce(c, F.lit("")), F.lower(x)))
    j = j.select("query_id", F.coalesce("n", F.lit(0)).alias("chunk_count"), "min_chunks", F.size(missing("expected_terms", F.col("text"))).cast("long").alias("missing_terms"),
                 F.size(missing("expected_documents", F.col("names"))).cast("long").alias("missing_documents"))
    return j.withColumn("passed", (F.col("chunk_count") >= F.col("min_chunks")) & (F.col("missing_terms") == 0) & (F.col("missing_documents") == 0)).drop("min_chunks")


def modality_counts(hits: DataFrame) -> DataFrame:
    """Hits of each query by modality."""
    kind = lb.hit_modality(F.col("modality"), F.col("document_name"), F.col("content"))
    return hits.groupBy("query_id", kind.alias("kind")).agg(F.count("*").alias("n"))
