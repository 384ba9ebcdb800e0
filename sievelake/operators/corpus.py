"""Dedup, snapshots, topology and sampling of a corpus of documents (doc_id, text, lang, source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import text as tx


def exact_groups(docs: DataFrame) -> DataFrame:
    """Each document's first copy: texts with one collapsed hash are copies; null texts are none.

    A group-by of the hash finds the first ids (map-side combined, so a hot text costs one row
    per task), and joins back on the hash.
    """
    h = docs.where("text IS NOT NULL").select("doc_id", tx.stable_hash(F.col("text")).alias("hash"))
    first = h.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return h.join(first, "hash").select("doc_id", "hash", "first_id", "copies", (F.col("doc_id") == F.col("first_id")).alias("kept"))


def near_key_groups(docs: DataFrame) -> DataFrame:
    """Sizes of groups that share the near-duplicate key of their tokens."""
    key = tx.near_duplicate_key(F.lit(None).cast("string"), F.col("text"), F.col("source"))
    return docs.where("text IS NOT NULL").groupBy(F.sha2(key, 256).alias("key")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


def document_coverage(docs: DataFrame) -> DataFrame:
    """Chunks, characters and their average per source."""
    return docs.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("chunks"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.round(F.avg(F.coalesce(F.length("text"), F.lit(0))), 3).alias("average_chars"))


def text_profile(docs: DataFrame) -> DataFrame:
    """Lengths, token counts, estimates, CJK and control characters of each text."""
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.length(t).cast("long").alias("chars"), F.size(tx.token_list(t)).cast("long").alias("tokens"), F.size(tx.evidence_tokens(t)).cast("long").alias("terms"),
                       tx.token_estimate(t).alias("token_estimate"), tx.cjk_count(t).alias("cjk"), tx.control_chars(t).alias("control_chars"), tx.preview(t).alias("preview"))


def quality_status(docs: DataFrame) -> DataFrame:
    """BLOCKED for empty texts or too many replacement (5%) or control (2%) characters, else PASS."""
    t = F.coalesce("text", F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    bad, ctl = F.round(F.regexp_count(t, F.lit("�")) / n, 6), F.round(tx.control_chars(t) / n, 6)
    blocked = (tx.collapse(t) == "") | (bad >= 0.05) | (ctl >= 0.02)
    return docs.select("doc_id", bad.alias("replacement_ratio"), ctl.alias("control_ratio"), F.when(blocked, "BLOCKED").otherwise("PASS").alias("status"))


def domain_terms(docs: DataFrame) -> DataFrame:
    """(source, term, df): in how many documents of a source a term is."""
    return docs.where("text IS NOT NULL AND source IS NOT NULL").select("source", F.explode(tx.topology_terms(F.col("text"))).alias("term")).groupBy("source", "term").agg(F.count("*").alias("df"))


def top_terms(docs: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` terms of each source in most documents, ties by term."""
    w = Window.partitionBy("source").orderBy(F.desc("df"), "term")
    return domain_terms(docs).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def domain_overlap(docs: DataFrame) -> DataFrame:
    """Jaccard of the vocabularies of sources that share a term, larger shares first.

    A term's sources are gathered to one set (bounded by the number of sources, not documents)
    and exploded to pairs of sources; no pair of documents is made.
    """
    terms = domain_terms(docs).select("source", "term")
    sizes = terms.groupBy("source").agg(F.count("*").alias("n"))
    sets = terms.groupBy("term").agg(F.sort_array(F.collect_set("source")).alias("s")).where("size(s) > 1")
    left = sets.select("s", F.posexplode("s").alias("i", "a"))
    pairs = left.select("a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("common"))
    j = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    v = F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 4)
    return j.select("a", "b", "common", v.alias("jaccard"), (v >= 0.28).alias("high_overlap"))


def ambiguous_terms(docs: DataFrame) -> DataFrame:
    """Per source: share of terms that other sources have too or that are ambiguous by themselves."""
    terms = domain_terms(docs)
    spread = terms.groupBy("term").agg(F.count("*").alias("sources"))
    vague = (F.col("sources") >= 2) | F.col("term").isin(tx.AMBIGUOUS_TERMS)
    ratio = F.round(F.count_if(vague) / F.count("*"), 4)
    return terms.join(spread, "term").groupBy("source").agg(F.count("*").alias("n_terms"), F.count_if(vague).alias("n_ambiguous"), ratio.alias("ratio"),
                                                             F.when(ratio >= 0.18, "high").when(ratio >= 0.08, "medium").otherwise("low").alias("level"))


def dominance(docs: DataFrame) -> DataFrame:
    """Per source: the largest document's share of its characters."""
    n = F.coalesce(F.length("text"), F.lit(0))
    share = F.when(F.sum(n) > 0, F.round(F.max(n) / F.sum(n), 4)).otherwise(0.0)
    return docs.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("documents"), share.alias("top_share"), ((share >= 0.8) & (F.count("*") > 1)).alias("dominant"))


def stratified_allocation(docs: DataFrame, size: int, by: str = "lang") -> DataFrame:
    """Rows to sample of each stratum by largest remainder, at least one each; ties by name."""
    c = docs.groupBy(F.coalesce(by, F.lit("unknown")).alias("stratum")).agg(F.count("*").alias("n"))
    all_rows = Window.partitionBy()
    ideal = size * F.col("n") / F.sum("n").over(all_rows)
    base = c.select("stratum", "n", ideal.alias("ideal"), F.greatest(F.floor(ideal), F.lit(1)).alias("base"))
    order = Window.orderBy(F.desc(F.round(F.col("ideal") - F.floor("ideal"), 9)), "stratum")
    spare = F.lit(size) - F.sum("base").over(all_rows)
    return base.select("stratum", "n", (F.col("base") + F.when(F.row_number().over(order) <= spare, 1).otherwise(0)).alias("allocated"))


def stratified_sample(docs: DataFrame, size: int, by: str = "lang", seed: str = "s") -> DataFrame:
    """The allocated number of rows of each stratum, smallest seeded sha256 of the id first.

    The hashes are even, so those wanted are under a bound that follows from the stratum's rows:
    twice the share, and some more. Only rows under it are sorted; a stratum in which repeated ids
    leave too few of them is sorted whole.
    """
    alloc = stratified_allocation(docs, size, by).select("stratum", "n", "allocated")
    bound = F.least(F.lit(1.0), (2.0 * F.col("allocated") + 100) / F.col("n"))
    d = docs.select("doc_id", F.coalesce(by, F.lit("unknown")).alias("stratum")).withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("doc_id").cast("string")), 256))
    d = d.withColumn("u", F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32).join(F.broadcast(alloc.withColumn("bound", bound)), "stratum")
    under = d.where(F.col("u") <= F.col("bound"))
    enough = under.groupBy("stratum").agg((F.count("*") >= F.first("allocated")).alias("enough"))
    chosen = d.join(F.broadcast(enough), "stratum", "left").where((F.col("u") <= F.col("bound")) | ~F.coalesce("enough", F.lit(False)))
    w = Window.partitionBy("stratum").orderBy("h", "doc_id")
    return chosen.withColumn("i", F.row_number().over(w)).where("i <= allocated").select("doc_id", "stratum")


def evidence_spans(docs: DataFrame, spans: DataFrame, broadcast_tokens: int = 1_000_000) -> DataFrame:
    """Documents that hold a span (item_id, text) as a run of whole tokens, with a confidence.

    Only the spans' tokens of each document are kept, in its row, without a shuffle while the spans'
    tokens are few enough to be sent to all executors. The four tokens of a span that are in fewest documents, all of them, pick candidates by an
    equi-join of ids only; a text is read as a run only where its id is a candidate, and containment of the token runs confirms it.
    Confidence: 0.85 less 0.05 for each further match, at most 0.25 less.
    """
    run = lambda c: F.concat(F.lit(" "), F.array_join(tx.token_list(c), " "), F.lit(" "))
    each = lambda c: F.explode(F.array_distinct(tx.token_list(c))).alias("token")
    tokens = spans.where("text IS NOT NULL").select("item_id", each(F.col("text")))
    known = tokens.select("token").distinct()
    small = known.limit(broadcast_tokens + 1).count() <= broadcast_tokens
    wanted = docs.where("text IS NOT NULL").select("doc_id", each(F.col("text"))).join(F.broadcast(known) if small else known, "token", "left_semi")
    df = wanted.groupBy("token").agg(F.count("*").alias("df"))
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("df", "token"))), 1, 4)
    rare = tokens.join(df, "token").groupBy("item_id").agg(rarest.alias("r")).select("item_id", F.size("r").alias("need"), F.explode("r.token").alias("token"))
    cand = wanted.join(rare, "token").groupBy("doc_id", "item_id", "need").agg(F.count("*").alias("got")).where("got = need").select("doc_id", "item_id")
    runs = docs.where("text IS NOT NULL").join(cand.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", run(F.col("text")).alias("doc_run"))
    hit = cand.join(runs, "doc_id").join(spans.select("item_id", run(F.col("text")).alias("span_run")), "item_id").where(F.contains("doc_run", "span_run")).select("item_id", "doc_id")
    n = hit.groupBy("item_id").agg(F.count("*").alias("n"))
    return hit.join(n, "item_id").select("item_id", "doc_id", F.round(0.85 - F.least(F.lit(0.25), 0.05 * (F.col("n") - 1)), 2).alias("confidence"))


def centroids(vectors: DataFrame) -> DataFrame:
    """Elementwise mean vector of each label; vectors are exploded, so sums combine map-side."""
    x = vectors.where("label IS NOT NULL").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: F.round(s["m"], 6)).alias("centroid"))
