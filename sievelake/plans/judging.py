"""Queries of the benchmark metrics over judgments planted in the tables: fields, tags, terms, documents and modalities of all kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import labels as lb
from sievelake.functions import text as tx
from sievelake.operators import corpus as co
from sievelake.operators import judging as ju
from sievelake.operators import metrics as me
from sievelake.operators import retrieval as rt
from sievelake.plans import registry as rg
from sievelake.plans.base import query, sql_collapse, table

K = 10


def _hits(s, d):
    docs = table(s, d, "documents")
    found = rt.lexical_topk(docs, rg._questions(s, d), K).select("query_id", "doc_id", "rank")
    suffix = F.when(F.col("doc_id") % 5 == 0, ".png").when(F.col("doc_id") % 5 == 1, "").otherwise(".md")
    return found.join(docs.select("doc_id", "text", "lang", "source"), "doc_id").select(
        "query_id", "rank", F.col("text").alias("content"), F.concat(F.coalesce("source", F.lit("none")), suffix).alias("document_name"),
        F.concat(F.lit("doc-"), "doc_id").alias("document_id"), F.col("doc_id").cast("string").alias("chunk_id"),
        F.when(F.col("doc_id") % 3 > 0, F.array(F.coalesce("lang", F.lit("none")))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(F.col("doc_id") % 7 == 0, "Data Table").alias("modality"),
    )


def _qrels(s, d):
    docs = table(s, d, "documents")
    found = co.evidence_spans(docs, table(s, d, "benchmark")).select(F.col("item_id").alias("query_id"), "doc_id")
    f = found.join(docs.select("doc_id", "text", "source"), "doc_id")
    row = lambda field, target, rel, o, on: F.when(on, F.struct(F.lit(field).alias("field"), target.alias("target"), rel.cast("double").alias("relevance"), (F.col("doc_id") * 4 + o).alias("ord")))
    i, one = F.col("query_id"), F.lit(1)
    rows = F.array(
        row("document_id", F.concat(F.lit("doc-"), "doc_id"), 1 + F.col("doc_id") % 2, 0, i % 4 != 3), row("expected_chunk", tx.stable_hash(F.col("text")), one, 1, i % 2 == 1),
        row("document", F.coalesce("source", F.lit("none")), F.lit(0.5), 2, i % 4 == 0), row("chunk_id", F.col("doc_id").cast("string"), F.lit(0), 3, F.lit(True)),
    )
    return f.select("query_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("query_id", "r.*")


def _cases(s, d):
    i = F.col("item_id")
    words = F.slice(tx.token_list(F.coalesce("text", F.lit(""))), 1, 2)
    none = F.array().cast("array<string>")
    label = F.when(i % 3 == 0, "table value").when(i % 3 == 1, "mixed").otherwise("plain")
    return table(s, d, "benchmark").select(
        i.alias("query_id"), F.concat(F.lit("t"), i % 3).alias("query_type"),
        F.array_sort(F.array_union(lb.expected_modalities(label), lb.category_modalities(lb.category(label)))).alias("expected_modalities"),
        F.when(i % 2 == 0, F.concat(words, F.array(F.lit(" zzz ")))).when(i % 5 == 1, none).otherwise(words).alias("expected_terms"),
        F.when(i % 4 == 1, F.array(F.lit("WEB"))).otherwise(none).alias("expected_documents"),
        F.when(i % 3 == 1, F.array(F.lit("EN "))).otherwise(none).alias("expected_tags"), F.when(i % 3 > 0, F.array(F.lit("de"))).otherwise(none).alias("allowed_tags"),
        F.when(i % 7 == 0, 11).otherwise(1).alias("min_chunks"),
    )


_REFS = "CASE WHEN {0} = '' THEN [] WHEN starts_with({0}, 'sha256:') THEN [{0}, substr({0}, 8)] WHEN regexp_matches({0}, '^[0-9a-f]{{64}}$') THEN [{0}, 'sha256:' || {0}] ELSE [{0}] END"
_MODALITY = """CASE WHEN doc_id % 7 = 0 THEN 'table' WHEN regexp_matches(lower(document_name), '\\.(png|jpg|jpeg|gif|webp|bmp|tif|tiff)$') THEN 'image'
  WHEN contains(lower(coalesce(content, '')), '<table') THEN 'table' WHEN regexp_matches(lower(document_name), '\\.(md|markdown|txt)$') THEN 'text' ELSE 'unknown' END"""

#: hits (hh), judgments (qr), cases (cs) and all metrics of a query (jm).
_SETUP = f"""{rg._hits_sql('h')},
hh AS MATERIALIZED (SELECT *, {_MODALITY} AS kind FROM (SELECT query_id, rank, doc_id, text AS content, coalesce(source, 'none') || CASE doc_id % 5
  WHEN 0 THEN '.png' WHEN 1 THEN '' ELSE '.md' END AS document_name, 'doc-' || doc_id AS document_id,
  doc_id::VARCHAR AS chunk_id, CASE WHEN doc_id % 3 > 0 THEN [lower(coalesce(lang, 'none'))]
    ELSE [] END AS tags, list_concat([doc_id::VARCHAR], [sha256({sql_collapse("coalesce(text, '')")}), 'sha256:' || sha256({sql_collapse("coalesce(text, '')")})]) AS refs
    FROM h JOIN documents USING (doc_id))),
qa AS (SELECT doc_id, text, source, {rg._RUN} AS r FROM documents WHERE text IS NOT NULL), qb AS (SELECT item_id AS query_id, {rg._RUN} AS q
  FROM benchmark WHERE text IS NOT NULL),
ev AS (SELECT query_id, doc_id, text, source FROM qa JOIN qb ON contains(r, q) WHERE q <> '  '),
qr AS MATERIALIZED (SELECT query_id, 'document_id' AS field, 'doc-' || doc_id AS target, 1.0 + doc_id % 2 AS relevance, doc_id * 4 AS ord FROM ev
  WHERE query_id % 4 <> 3
  UNION ALL SELECT query_id, 'expected_chunk', sha256({sql_collapse('text')}), 1.0, doc_id * 4 + 1 FROM ev WHERE query_id % 2 = 1
  UNION ALL SELECT query_id, 'document', coalesce(source, 'none'), 0.5, doc_id * 4 + 2 FROM ev WHERE query_id % 4 = 0),
rl AS MATERIALIZED (SELECT *, lower(field || ':' || target) AS key, field = 'expected_chunk' AS chunky, field <> 'expected_chunk'
  OR max((field <> 'expected_chunk')::INT) OVER (PARTITION BY query_id) = 0 AS ranks FROM qr),
cs AS MATERIALIZED (SELECT item_id AS query_id, 't' || item_id % 3 AS query_type, CASE item_id % 3 WHEN 0 THEN ['table']
  WHEN 1 THEN ['image', 'mixed', 'table'] ELSE [] END AS expected_modalities,
  CASE WHEN item_id % 2 = 0 THEN list_concat(w[1:2], [' zzz ']) WHEN item_id % 5 = 1 THEN [] ELSE w[1:2] END AS expected_terms, CASE
    WHEN item_id % 4 = 1 THEN ['web'] ELSE [] END AS expected_documents,
  CASE WHEN item_id % 3 = 1 THEN ['en'] ELSE [] END AS expected_tags, CASE item_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['de', 'en']
    ELSE ['de'] END AS allowed_tags, CASE WHEN item_id % 7 = 0 THEN 11 ELSE 1 END AS min_chunks
  FROM (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '{tx.TOKEN}') AS w FROM benchmark))"""
_MATCH = """CASE field WHEN 'document_id' THEN contains(document_id, lower(target)) WHEN 'expected_chunk' THEN list_has_any(refs, [target, 'sha256:' || target])
  ELSE contains(lower(document_name), lower(target)) OR contains(document_id, lower(target)) OR contains(chunk_id, lower(target)) END"""
_JUDGED = f"""{_SETUP},
pr AS (SELECT query_id, rank, arg_max(key, {{'r': relevance, 'o': -ord}}) AS key, any_value(kind) AS kind FROM hh JOIN rl USING (query_id) WHERE ranks
  AND {_MATCH} GROUP BY query_id, rank),
ky AS (SELECT query_id, key, max(relevance) AS rel FROM rl WHERE ranks GROUP BY ALL),
idl AS (SELECT query_id, count(*) AS n_rel, sum((2 ** rel - 1) / log2(i + 1)) FILTER (i <= 10) AS ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, key) AS i FROM ky) GROUP BY 1),
fd AS (SELECT query_id, key, rank, rel, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM (SELECT query_id, key, min(rank) AS rank
  FROM pr GROUP BY ALL) JOIN ky USING (query_id, key)),
got AS (SELECT query_id, count(*) AS n, min(rank) AS first, sum((2 ** rel - 1) / log2(rank + 1)) AS dcg, sum(nth / rank) AS ap FROM fd GROUP BY 1),
mm AS (SELECT query_id, count(DISTINCT key) FILTER (kind = 'image') AS mi, count(DISTINCT key) FILTER (kind = 'table') AS mt FROM pr GROUP BY 1),
st AS (SELECT query_id, count(DISTINCT target) AS xn FROM rl WHERE chunky GROUP BY 1),
sh AS (SELECT query_id, rank, arg_min(target, ord) AS t FROM hh JOIN rl USING (query_id) WHERE chunky
  AND list_has_any(refs, [target, 'sha256:' || target]) GROUP BY ALL),
sg AS (SELECT query_id, count(DISTINCT t) AS xm, min(rank) AS xr FROM sh GROUP BY 1),
wd AS (SELECT h0.query_id, count(*) AS dn, count(*) FILTER (NOT EXISTS (SELECT 1 FROM rl WHERE rl.query_id = h0.query_id AND NOT chunky
  AND (contains(h0.document_id, lower(target)) OR (field = 'document' AND contains(lower(h0.document_name), lower(target)))))
  AND NOT EXISTS (SELECT 1 FROM cs WHERE cs.query_id = h0.query_id AND len(expected_documents) > 0
    AND contains(lower(h0.document_name), 'web'))) AS dw FROM hh h0 GROUP BY 1),
sw AS (SELECT query_id, {sql_collapse("string_agg(lower(coalesce(content, '') || chr(10) || document_name || chr(10) || document_id), ' ' ORDER BY rank)")} AS text, list(tags) FILTER (len(tags) > 0) AS tg,
  count(*) FILTER (kind = 'image') AS ni FROM hh GROUP BY 1),
jx AS (SELECT cs.*, n_rel, coalesce(n, 0) AS n, first, dcg, ideal, coalesce(ap, 0) AS ap, coalesce(mi, 0) AS mi, coalesce(mt, 0) AS mt, xn,
  coalesce(xm, 0) AS xm, xr, coalesce(dn, 0) AS dn, coalesce(dw, 0) AS dw, coalesce(tg, []) AS tg,
  coalesce(ni, 0) AS ni, sw.query_id IS NULL AS nothing,
  len(expected_terms) AS tn, len(list_filter(expected_terms, lambda t: contains(coalesce(sw.text, ''), trim(t)))) AS tm, len(expected_documents) > 0
    OR EXISTS (SELECT 1 FROM rl WHERE rl.query_id = cs.query_id AND NOT chunky) AS scoped,
  list_distinct(flatten(coalesce(tg, []))) AS rt, len(list_filter(coalesce(tg, []), lambda t: NOT list_has_all(allowed_tags, t))) AS pn
  FROM cs JOIN idl USING (query_id) LEFT JOIN got USING (query_id) LEFT JOIN mm USING (query_id) LEFT JOIN st USING (query_id) LEFT JOIN sg USING (query_id) LEFT JOIN wd USING (query_id) LEFT JOIN sw USING (query_id)),
jm AS MATERIALIZED (SELECT query_id, query_type, (n > 0)::DOUBLE AS hit_rate, round(coalesce(1 / first, 0), 6) AS mrr,
  round(n / 10, 6) AS precision_at_k, round(n / n_rel, 6) AS recall_at_k, round(coalesce(dcg / ideal, 0), 6) AS ndcg_at_k,
  round(ap / n_rel, 6) AS map_at_k,
  nothing::INT::DOUBLE AS empty_result_rate, round(n / n_rel, 6) AS supporting_document_coverage, round(xm / xn, 6) AS strict_chunk_recall_at_k, CASE
    WHEN xn > 0 THEN (xm > 0)::INT::DOUBLE END AS expected_chunk_hit_rate, CASE WHEN xn > 0 THEN
    coalesce(xr, 11)::DOUBLE END AS expected_evidence_rank,
  CASE WHEN tn > 0 THEN round(tm / tn, 6) END AS expected_term_recall_at_k, CASE
    WHEN tn > 0 THEN (tm = tn)::INT::DOUBLE END AS expected_term_hit_rate, CASE WHEN tn > 0 AND list_contains(expected_modalities, 'table') THEN
    round(tm / tn, 6) END AS table_term_recall_at_k,
  CASE WHEN tn > 0 AND list_contains(expected_modalities, 'table') THEN (tm = tn)::INT::DOUBLE END AS table_term_hit_rate, CASE WHEN scoped THEN CASE
    WHEN dn > 0 THEN round(dw / dn, 6) ELSE 0 END END AS wrong_document_rate,
  CASE WHEN len(expected_tags) > 0 THEN round(len(list_intersect(rt, expected_tags)) / len(expected_tags), 6) END AS expected_tag_hit_rate, CASE WHEN
    len(allowed_tags) > 0 THEN CASE WHEN len(tg) > 0 THEN round(pn / len(tg), 6) ELSE 0 END END AS tag_pollution_rate,
  CASE WHEN len(allowed_tags) > 0 THEN (NOT list_has_all(allowed_tags, rt))::INT::DOUBLE END AS unexpected_tag_hit_rate, CASE
    WHEN list_contains(expected_modalities, 'image') THEN round(mi / 10, 6) END AS image_precision_at_k,
  CASE WHEN list_contains(expected_modalities, 'image') THEN round(mi / n_rel, 6) END AS image_recall_at_k, CASE
    WHEN list_contains(expected_modalities, 'image') THEN (ni > 0)::INT::DOUBLE END AS visual_coverage, CASE
    WHEN list_contains(expected_modalities, 'table') THEN round(mt / n_rel, 6) END AS table_recall_at_k,
  xn AS expected_chunk_count, CASE WHEN xn > 0 THEN xm END AS matched_expected_chunks, CASE WHEN tn > 0 THEN tn END AS expected_term_count, CASE
    WHEN tn > 0 THEN tm END AS matched_expected_terms, CASE WHEN scoped THEN dn END AS document_scored_chunk_count, CASE
    WHEN scoped THEN dw END AS wrong_document_count,
  CASE WHEN len(expected_tags) > 0 THEN len(expected_tags) END AS expected_tag_count, CASE WHEN len(expected_tags) > 0 THEN len(list_intersect(rt, expected_tags)) END AS matched_expected_tags, CASE WHEN len(allowed_tags) > 0 THEN len(tg) END AS tagged_chunk_count, CASE WHEN len(allowed_tags) > 0 THEN pn END AS polluted_tagged_chunk_count FROM jx)"""


def _judged(s, d):
    return ju.judge(_hits(s, d), _qrels(s, d), _cases(s, d), K)


@query(f"WITH {_JUDGED} SELECT * FROM jm")
def ir_metrics_full(s, d):
    return _judged(s, d)


_MEANS = "count(*) AS query_count, " + ", ".join([f"round(avg({c}), 6) AS {c}" for c in ju.BASE + ju.OPTIONAL] + [f"sum({c})::BIGINT AS {c}" for c in ju.COUNTS]) + (
    ", count(expected_term_recall_at_k) AS expected_term_query_count, count(tag_pollution_rate) AS tag_scope_query_count, count(wrong_document_rate) AS document_scope_query_count")


@query(f"WITH {_JUDGED} SELECT coalesce(query_type, 'all') AS query_type, {_MEANS} FROM jm GROUP BY ROLLUP (query_type)")
def metrics_by_type(s, d):
    return ju.averages(_judged(s, d), by_type=True)


_THRESHOLDS = [("hit_rate", "min", 0.5), ("mrr", "min", 0.99), ("precision_at_k", "min", 0.01), ("recall_at_k", "min", 0.99), ("ndcg_at_k", "min", 0.2), ("map_at_k", "min", 0.999), ("strict_chunk_recall_at_k", "min", 0.1),
               ("expected_chunk_hit_rate", "min", 0.1), ("expected_term_recall_at_k", "min", 0.1), ("table_term_recall_at_k", "min", 0.9), ("expected_evidence_rank", "max", 5.0), ("empty_result_rate", "max", 0.0), ("other", "min", 0.1)]
_CHECKS = f"""{_JUDGED}, g AS (SELECT {_MEANS} FROM jm), x AS (UNPIVOT (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in ju.BASE + ju.OPTIONAL)} FROM g) ON {', '.join(ju.BASE + ju.OPTIONAL)} INTO NAME metric VALUE actual),
ck AS (SELECT metric, CASE op WHEN 'min' THEN actual >= threshold ELSE actual <= threshold END AS passed FROM (VALUES {', '.join(map(str, _THRESHOLDS))}) AS v(metric, op, threshold) JOIN x USING (metric))"""


@query(f"WITH {_CHECKS} SELECT count(*) AS checks, array_to_string(list_sort(list(metric) FILTER (NOT passed)), ',') AS failed_metrics, bool_and(passed) AS ok, CASE WHEN bool_and(passed) THEN 'passed' ELSE 'failed' END AS status FROM ck")
def gate_all(s, d):
    thresholds = s.createDataFrame(_THRESHOLDS, "metric string, op string, threshold double")
    report = ju.gate_report(me.gate(ju.long_metrics(ju.averages(_judged(s, d))), thresholds))
    return report.withColumn("failed_metrics", F.array_join("failed_metrics", ","))


@query(f"""WITH {_SETUP}, v AS (SELECT query_id, count(*) AS n, string_agg(lower(coalesce(content, '') || chr(10) || document_name || chr(10) || document_id), chr(10) ORDER BY rank) AS text, string_agg(lower(document_name || chr(10) || document_id), chr(10) ORDER BY rank) AS names FROM hh GROUP BY 1),
w AS (SELECT query_id, coalesce(n, 0) AS chunk_count, min_chunks,
  len(list_filter(expected_terms, lambda t: NOT contains(coalesce(text, ''), t))) AS missing_terms,
  len(list_filter(expected_documents, lambda t: NOT contains(coalesce(names, ''), t))) AS missing_documents FROM cs LEFT JOIN v USING (query_id))
SELECT query_id, chunk_count, missing_terms, missing_documents, chunk_count >= min_chunks AND missing_terms = 0 AND missing_documents = 0 AS passed FROM w""")
def validate_cases(s, d):
    return ju.validate(_hits(s, d), _cases(s, d))


@query(f"WITH {_SETUP} SELECT query_id, kind, count(*) AS n FROM hh GROUP BY ALL")
def modality_distribution(s, d):
    return ju.modality_counts(_hits(s, d))
