"""Snapshots and their review, benchmark checks, tag sets, topology plans, route reports, citation and pollution checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import labels as lb
from sievelake.functions import text as tx
from sievelake.operators.scores import rate

# Patterns and bounds that results depend on.
TABLE_HINT = r"(?im)<table\b|</table>|^\s*\|.*\|\s*$"
IMAGE_HINT = r"!\[[^\]]*\]\([^)]+\)"
DELIMITER = r"(?i)<!--\s*chunk\s*-->"
TAG_NAME = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,63}$"
RISK_BASE = {"bridge_term": 0.25, "source_boundary": 0.82, "allowed_tag_review": 0.88, "unexpected_tag": 0.93}
CHARS_A_CHUNK = 3000


# --- snapshots


def snapshot(chunks: DataFrame) -> DataFrame:
    """Chunks (pos, chunk_id, document, content) whose content is the first of its hash, with the hash and the number of copies."""
    h = chunks.withColumn("stable_hash", lb.chunk_hash(F.col("content")))
    first = F.min_by(F.struct("pos", "chunk_id", "document"), "pos")
    return h.groupBy("stable_hash").agg(first.alias("f"), F.count("*").alias("copies"), F.max(F.length("content")).alias("chars")).select("f.pos", "f.chunk_id", "f.document", "stable_hash", "copies", "chars")


def snapshot_summary(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct ones, and shares that have an id, a document and a content."""
    share = lambda c: rate(F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != ""), F.count("*")).alias(f"{c}_coverage")
    return chunks.agg(F.count("*").alias("source_chunks"), F.count_distinct(lb.chunk_hash(F.col("content"))).alias("chunks"), share("chunk_id"), share("document"), share("content"))


def snapshot_review(chunks: DataFrame) -> DataFrame:
    """One row of counts: table-like chunks, tables split over chunks, repeated tables, chunks of images only, visible delimiters.

    A split table is a table-like chunk whose last table-like chunk before it is of the same document: the order is
    global, so only (pos, document) of table-like chunks enter that window.
    """
    text = F.coalesce("content", F.lit(""))
    c = chunks.select("pos", F.coalesce("document", F.lit("<unknown>")).alias("document"), text.alias("t"), text.rlike(TABLE_HINT).alias("table"))
    rows = F.filter(F.transform(F.split("t", "\n"), lambda x: F.lower(tx.collapse(x))), lambda x: x.rlike(r"\||<t[hrd]"))
    signature = F.substring(F.array_join(F.slice(rows, 1, 12), "\n"), 1, 2000)
    like = c.where("table").select("pos", "document", F.sha2(signature, 256).alias("signature"), (signature != "").alias("signed"))
    split = like.withColumn("before", F.lag("document").over(Window.orderBy("pos"))).agg(F.count_if(F.col("before") == F.col("document")).alias("split_tables"))
    again = like.where("signed").groupBy("signature").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_tables"))
    without = c.where("not table").select("document").distinct().agg(F.count("*").alias("documents_without_tables"))
    images = F.count_if(F.col("t").rlike(IMAGE_HINT) & (F.trim(F.regexp_replace("t", IMAGE_HINT, "")) == ""))
    counts = c.agg(F.count("*").alias("chunks"), F.count_if("table").alias("table_like"), images.alias("image_only"), F.count_if(F.col("t").rlike(DELIMITER)).alias("delimiter_visible"), F.coalesce(F.max(F.length("t")), F.lit(0)).alias("max_chars"))
    out = counts.join(F.broadcast(split), F.lit(True)).join(F.broadcast(again), F.lit(True)).join(F.broadcast(without), F.lit(True))
    return out.withColumn("documents_without_tables", F.when(F.col("table_like") > 0, F.col("documents_without_tables")).otherwise(0))


# --- benchmarks


def preflight(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(code, severity, query_id): queries without a positive judgment, and judgments without a query."""
    judged = qrels.where("relevance > 0").select("query_id").distinct()
    issue = lambda d, code, severity: d.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "query_id")
    bare = queries.select("query_id").distinct().join(judged, "query_id", "left_anti")
    orphan = judged.join(queries, "query_id", "left_anti")
    return issue(bare, "query_without_qrels", "error").unionByName(issue(orphan, "qrels_without_query", "warning"))


def delta_report(deltas: DataFrame) -> DataFrame:
    """(direction, metrics) of metric deltas: how many and which metrics went which way."""
    return deltas.groupBy("direction").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("metric")).alias("metrics"))


def suppression_risk(kind: Column, queries: Column, chunks: Column) -> Column:
    """Risk of suppressing a term, source or tag, by its kind and how much it pollutes; 2 digits."""
    base = F.coalesce(F.element_at(lb.literal_map(RISK_BASE), kind), F.lit(0.75))
    return tx.round_half(F.least(F.lit(0.99), base + F.least(F.lit(0.15), queries * 0.03) + F.least(F.lit(0.1), chunks * 0.02)), 2)


# --- tags


def tagset_issues(tags: DataFrame, assignments: DataFrame) -> DataFrame:
    """(code, severity, name) of (pos, name) tags and (path, tags) assignments: repeated, malformed and unknown names."""
    repeated = tags.withColumn("k", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("pos"))).where("k > 1")
    bad = tags.where(~F.col("name").rlike(TAG_NAME))
    orphan = assignments.select(F.explode("tags").alias("name")).join(tags.select("name").distinct(), "name", "left_anti")
    issue = lambda d, code, severity: d.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "name")
    return issue(repeated, "tag_duplicate_name", "warning").unionByName(issue(bad, "tag_name_invalid", "error")).unionByName(issue(orphan, "assignment_orphan_tag", "warning"))


def tagset_report(tags: DataFrame, assignments: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: tags never assigned, assigned names that are no tags, documents (path) without an assignment."""
    names, used = tags.select("name").distinct(), assignments.select(F.explode("tags").alias("name")).distinct()
    count = lambda d, c: d.agg(F.count("*").alias(c))
    parts = [count(used, "assigned_tags"), count(names.join(used, "name", "left_anti"), "unused_tags"), count(used.join(names, "name", "left_anti"), "orphan_tags"),
             count(documents.select("path").distinct().join(assignments, "path", "left_anti"), "unassigned_documents")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), F.lit(True))
    return out


# --- topology


def domains(documents: DataFrame) -> DataFrame:
    """Per domain: documents, estimated chunks (3,000 characters each, one at least), characters, and shares of all."""
    n = F.coalesce(F.length("text"), F.lit(0))
    d = documents.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(
        F.count("*").alias("documents"), F.sum(F.greatest(F.lit(1), F.ceil(n / CHARS_A_CHUNK))).alias("chunks"), F.sum(n).alias("chars"))
    everything = Window.partitionBy()
    return d.withColumn("chunk_share", rate(F.col("chunks"), F.sum("chunks").over(everything))).withColumn("char_share", rate(F.col("chars"), F.sum("chars").over(everything)))


def split_groups(documents: DataFrame, least_documents: int = 3, least_chunks: int = 10) -> DataFrame:
    """What to do with each domain: a knowledge base of its own, or a review."""
    large = (F.col("documents") >= least_documents) | (F.col("chunks") >= least_chunks)
    number = F.row_number().over(Window.orderBy("domain"))
    name = F.format_string("split-%03d-%s", number, tx.slug(F.col("domain")))
    return domains(documents).select(name.alias("id"), "domain", "documents", "chunks", "chars", F.when(large, "standalone_kb_candidate").otherwise("merge_or_stage_review").alias("action"))


def corpus_size(documents: DataFrame, least_documents: int = 3, least_chars: int = 1200) -> DataFrame:
    n = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    return n.withColumn("status", F.when((F.col("documents") >= least_documents) | (F.col("chars") >= least_chars), "sufficient").otherwise("thin"))


def recommendation(split_review: Column, high_overlap: Column, thin: Column, growth: Column, independent: Column) -> Column:
    """What to do with a corpus, and how sure that is: the first that fits."""
    out = lambda a, b: F.struct(F.lit(a).alias("action"), F.lit(b).alias("confidence"))
    return (
        F.when(split_review, out("split_before_upload", "medium")).when(high_overlap & thin, out("merge", "medium")).when(thin & (growth == "low"), out("stage", "medium"))
        .when(independent & ~thin, out("create", "high")).otherwise(out("create", "medium"))
    )


# --- routes


def bucket_totals(cases: DataFrame, by: tuple[str, ...] = ("category", "locale", "negative_class")) -> DataFrame:
    """(dimension, value, total, passed, pass_rate): one pass over cases for each single dimension; empty values are left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in by))).alias("b")
    return cases.select("passed", pairs).where("coalesce(b.value, '') <> ''").groupBy("b.dimension", "b.value").agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed")).withColumn("pass_rate", rate(F.col("passed"), F.col("total")))


def hint_conflicts(bases: DataFrame) -> DataFrame:
    """Pairs of hints of different knowledge bases (pos, name, hints) of which one holds the other, each pair once.

    Pairs are made by the first three characters of a hint (or all of a shorter one), which the other holds at some place.
    """
    h = bases.select("pos", "name", F.explode("hints").alias("hint")).select("*", F.lower(F.trim("hint")).alias("k")).where("k <> ''")
    at = F.sequence(F.lit(1), F.length("k"))
    grams = F.array_distinct(F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(at, lambda i: F.substring("k", i, n)))))
    parts = h.withColumn("g", F.explode(grams))
    own = h.withColumn("g", F.substring("k", 1, 3))
    a, b = own.alias("a"), parts.alias("b")
    pairs = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.pos") != F.col("b.pos"))).where(F.contains(F.col("b.k"), F.col("a.k")))
    small = F.col("a.pos") < F.col("b.pos")
    pick = lambda c: (F.when(small, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")), F.when(small, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")))
    (n1, n2), (h1, h2) = pick("name"), pick("hint")
    return pairs.select(n1.alias("left"), h1.alias("left_hint"), n2.alias("right"), h2.alias("right_hint")).distinct()


# --- answers


def citation_audit(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations like [1] of each answer (answer_id, text) against its evidence (answer_id, rank, preview).

    invalid: cited ranks that there are not; unsupported: sentences of 20 characters or more without
    a citation that share no token with any preview. FAIL with an invalid one, REVIEW with an
    unsupported sentence or evidence and no citation, else PASS.
    """
    e = evidence.groupBy("answer_id").agg(F.array_distinct(F.collect_list("rank")).alias("ranks"), F.array_distinct(F.flatten(F.collect_list(tx.evidence_tokens(F.col("preview"))))).alias("terms"))
    none = F.array().cast("array<string>")
    t = F.coalesce("text", F.lit(""))
    cited = F.transform(F.regexp_extract_all(t, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))
    ranks = F.coalesce(F.transform("ranks", lambda x: x.cast("long")), F.array().cast("array<long>"))
    plain = F.filter(tx.sentences(t), lambda s: ~s.rlike(r"\[\d+\]") & (F.size(tx.evidence_tokens(s)) > 0) & ~F.arrays_overlap(tx.evidence_tokens(s), F.coalesce("terms", none)))
    j = answers.join(e, "answer_id", "left").select("answer_id", cited.alias("cited"), ranks.alias("ranks"), F.size(plain).cast("long").alias("unsupported"))
    j = j.select("answer_id", F.size("cited").cast("long").alias("citations"), F.size(F.array_distinct(F.array_intersect("cited", "ranks"))).cast("long").alias("cited_evidence"),
                 F.size(F.array_except("cited", "ranks")).cast("long").alias("invalid"), "unsupported", F.size("ranks").cast("long").alias("evidence"))
    missing = (F.col("evidence") > 0) & (F.col("citations") == 0)
    return j.withColumn("status", F.when(F.col("invalid") > 0, "FAIL").when(missing | (F.col("unsupported") > 0), "REVIEW").otherwise("PASS"))


def pollution(hits: DataFrame, low: float = 0.25) -> DataFrame:
    """Per query: hits that match its expanded terms only, or its own terms too little; hits are (query_id, rank, question, expanded, document, content)."""
    own = tx.pollution_tokens(F.col("question"))
    more = F.array_except(tx.pollution_tokens(F.array_join("expanded", " ")), own)
    found = tx.pollution_tokens(F.concat_ws(" ", "content", "document"))
    h = hits.select("query_id", "document", F.size(own).alias("n"), F.size(F.array_intersect(own, found)).alias("o"), F.array_intersect(more, found).alias("e"))
    only = (F.size("e") > 0) & (F.col("o") == 0)
    weak = (F.size("e") > 0) & (rate(F.col("o"), F.col("n")) < low)
    top = h.groupBy("query_id", "document").agg(F.count("*").alias("k")).groupBy("query_id").agg(F.max("k").alias("most"))
    q = h.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if(only).alias("expansion_only"), F.count_if(weak).alias("low_coverage"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("e")))).alias("bridge_terms"))
    dominant = (F.col("hits") >= 3) & (F.col("most") * 2 >= F.col("hits"))
    return q.join(top, "query_id").select("query_id", "hits", "expansion_only", "low_coverage", "bridge_terms", dominant.alias("source_dominance"), F.when((F.col("expansion_only") > 0) | (F.col("low_coverage") > 0), "REVIEW").otherwise("PASS").alias("status"))
