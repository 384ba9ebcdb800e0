"""Queries of states, snapshots, tags, topology, routes, citations and pollution: over the tables, or over rows stated here where the tables have none such."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import text as tx
from sievelake.operators import conversation as cv
from sievelake.operators import governance as go
from sievelake.operators import metrics as me
from sievelake.operators import states as st
from sievelake.plans import registry as rg
from sievelake.plans.base import query, sql_collapse, sql_list, sql_tokens, table
from sievelake.plans.scalars import values

_STATES = [(1, "Running", "x", "0.5", None, "a.PNG", ""), (2, None, "ok", "1.0", "", "b.md", None), (3, "", "", "-1", None, "c", "text/plain"), (4, None, "done", "0.2", "[ERROR] no", "d.txt", "IMAGE/x"), (5, None, None, None, None, None, None), (6, None, "", "abc", "fine", "e.markdown", "x/y"), (7, "DONE", None, "0.1", "", "f", "text/markdown"), (8, "done", None, "-0.5", "", "f", "")]
_STATE = "id long, run string, status string, progress string, message string, name string, mime string"
_EFF = """CASE WHEN coalesce(trim(run), '') <> '' THEN lower(trim(run)) WHEN TRY_CAST(progress AS DOUBLE) >= 1 THEN '1' WHEN TRY_CAST(progress AS DOUBLE) < 0 THEN '-1' WHEN regexp_matches(lower(coalesce(message, '')), '\\[error\\]|exception|fail') THEN 'failed'
  WHEN coalesce(trim(status), '') <> '' THEN lower(trim(status)) WHEN coalesce(trim(progress), '') <> '' THEN lower(trim(progress)) ELSE 'pending' END"""
_FAIL = f"s IN ({sql_list(st.FAILED)[1:-1]}) OR coalesce(TRY_CAST(progress AS DOUBLE) < 0, false) OR regexp_matches(lower(coalesce(message, '')), '\\[error\\]|exception|fail')"


@query(f"""WITH {values("r", _STATE, _STATES)}, e AS (SELECT *, {_EFF} AS s FROM r)
SELECT id, s AS state, {_FAIL} AS failed, s IN ({sql_list(st.SUCCEEDED)[1:-1]}) AND NOT ({_FAIL}) AS succeeded, CASE
  WHEN starts_with(lower(coalesce(mime, '')), 'image/')
  OR regexp_matches(lower(coalesce(name, '')), '\\.(png|jpg|jpeg|gif|webp|bmp|tif|tiff)$') THEN 'image'
WHEN regexp_matches(lower(coalesce(name, '')), '\\.(md|markdown)$') OR lower(coalesce(mime, '')) IN ('text/markdown', 'text/x-markdown') THEN 'markdown' WHEN starts_with(lower(coalesce(mime, '')), 'text/') THEN 'text' ELSE 'other' END AS kind FROM e""")
def document_states(s, d):
    r = s.createDataFrame(_STATES, _STATE)
    c = {x: F.col(x) for x in ("run", "status", "progress", "message")}
    r = r.withColumn("state", st.effective_state(**c))
    args = (F.col("state"), F.col("progress"), F.col("message"))
    return r.select("id", "state", st.has_failed(*args).alias("failed"), st.has_succeeded(*args).alias("succeeded"), st.document_kind(F.col("name"), F.col("mime")).alias("kind"))


@query("""WITH m AS (SELECT doc_id::VARCHAR AS document_id, 'in/' || coalesce(source, 'none') || '/' || doc_id || '.md' AS path FROM documents),
o AS (SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN (doc_id // 2)::VARCHAR ELSE '' END AS document_id, CASE doc_id % 4 WHEN 0 THEN 'in/' ||
  coalesce(source, 'none') || '/' || (doc_id + 1) || '.md' WHEN 1 THEN (doc_id // 3) || '.md'
  ELSE '' END AS name, 's' || doc_id % 5 || '-' || doc_id AS state FROM documents),
i AS (SELECT document_id, arg_max(state, pos) AS s FROM o WHERE document_id <> '' GROUP BY 1), k AS (SELECT key, arg_min(state, pos) AS s
  FROM (SELECT pos, state, unnest(list_distinct([name, regexp_extract(name, '([^/]*)$', 1)])) AS key FROM o) WHERE key <> '' GROUP BY 1)
SELECT m.document_id, path, coalesce(i.s, p.s, b.s) AS state FROM m LEFT JOIN i USING (document_id) LEFT JOIN k p ON p.key = path LEFT JOIN k b ON b.key = regexp_extract(path, '([^/]*)$', 1)""")
def join_status(s, d):
    docs = table(s, d, "documents")
    path = lambda i: F.concat(F.lit("in/"), F.coalesce("source", F.lit("none")), F.lit("/"), i, F.lit(".md"))
    i = F.col("doc_id")
    manifest = docs.select(i.cast("string").alias("document_id"), path(i).alias("path"))
    name = F.when(i % 4 == 0, path(i + 1)).when(i % 4 == 1, F.concat(F.floor(i / 3), F.lit(".md"))).otherwise("")
    observed = docs.select(i.alias("pos"), F.when(i % 3 == 0, F.floor(i / 2).cast("string")).otherwise("").alias("document_id"), name.alias("name"), F.concat(F.lit("s"), i % 5, F.lit("-"), i).alias("state"))
    return st.match_status(manifest, observed)


@query("""WITH e AS (SELECT event_id, value * 1000 AS ms, CASE event_id % 4 WHEN 0 THEN ' OCR' WHEN 1 THEN 'parse' WHEN 2 THEN 'other' END AS phase FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 AND ms >= 30000 THEN 'slow_image_vlm_processing' WHEN event_id % 4 = 1
  AND ms >= 60000 THEN 'slow_parse_phase' END AS phase_warning, CASE WHEN event_id % 2 = 0 AND ms >= 30000 THEN 'slow_image_vlm_processing'
  WHEN event_id % 2 = 1 AND ms >= 60000 THEN 'slow_parse_phase' END AS stage_warning,
coalesce(CASE WHEN event_id % 5 = 0 THEN event_id % 2 > 0 ELSE ms / (event_id % 5 * 20 * 1000) >= 0.8 END, false) AS near_timeout FROM e""")
def performance_warnings(s, d):
    i, ms = F.col("event_id"), F.col("value") * 1000
    phase = F.when(i % 4 == 0, " OCR").when(i % 4 == 1, "parse").when(i % 4 == 2, "other")
    return table(s, d, "events").select("event_id", st.phase_warning(phase, ms).alias("phase_warning"), st.stage_warning(ms, i % 2 == 0).alias("stage_warning"), st.polling_warning(i % 5 * 20, ms, i % 2).alias("near_timeout"))


@query("""WITH c AS (SELECT l_partkey AS document_id, count(*) * 40 AS chunk_count FROM lineitem GROUP BY 1)
SELECT document_id, 'high_document_chunk_count' AS code, chunk_count::BIGINT AS chunk_count FROM c WHERE chunk_count >= 1000 UNION ALL SELECT NULL, 'high_total_chunk_count', sum(chunk_count)::BIGINT FROM c HAVING sum(chunk_count) >= 10000""")
def chunk_warnings(s, d):
    counts = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("document_id")).agg((F.count("*") * 40).alias("chunk_count"))
    return st.chunk_warnings(counts)


@query("SELECT n::BIGINT AS attempts, array_to_string(list_transform(range(0, n - 1), lambda i: round(least(8.0, 0.5 * 2 ** i), 3)::DOUBLE), ',') AS delays FROM range(1, 9) AS r(n)")
def retry_delays(s, d):
    return s.range(1, 9).select(F.col("id").alias("attempts"), F.array_join(F.transform(st.retry_delays(F.col("id").cast("int"), 0.5, 2.0, 8.0), lambda x: x.cast("string")), ",").alias("delays"))


@query()
def rate_limits(s, d):
    e = table(s, d, "events")
    return st.rate_limit(e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at")), 1 / 7200, 2)


@query()
def circuit_breakers(s, d):
    e = table(s, d, "events")
    return st.circuit(e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.col("event_type").alias("status")), 2, 86400.0, ["view", "error"])


# --- snapshots and benchmarks

_CHUNK = "chunk string, document string, content string"
_TABLES = [("t1", "a", "| x | y |\n|---|---|\n| 1 | 2 |"), ("t2", "a", "|  X | y |\n|---|---|\n| 1 | 2 |"), ("t3", "b", "<table><tr><td>1</td></tr></table>"), ("t4", "b", "![i](x.png) "), ("t5", None, "a <!-- CHUNK --> b"), ("t6", "b", "</table> rest"), ("t7", "c", None)]
_SNAP = f"""{values("p", _CHUNK, _TABLES)}, c AS MATERIALIZED (SELECT doc_id AS pos, doc_id::VARCHAR AS chunk_id, source AS document, text AS content FROM documents UNION ALL SELECT 1000000 + row_number() OVER (ORDER BY chunk), chunk, document, content FROM p),
x AS MATERIALIZED (SELECT *, 'sha256:' || sha256({sql_collapse("coalesce(content, '')")}) AS stable_hash FROM c)"""


def _chunks(s, d):
    own = s.createDataFrame([(1000001 + i, *r) for i, r in enumerate(_TABLES)], "pos long, chunk_id string, document string, content string")
    return table(s, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document"), F.col("text").alias("content")).unionByName(own)


@query(f"WITH {_SNAP} SELECT min(pos) AS pos, arg_min(chunk_id, pos) AS chunk_id, (min_by({{'d': document}}, pos)).d AS document, stable_hash, count(*) AS copies, max(length(content)) AS chars FROM x GROUP BY stable_hash")
def chunk_snapshot(s, d):
    return go.snapshot(_chunks(s, d))


_SHARE = lambda c: f"round(count(*) FILTER (coalesce({c}, '') <> '') / count(*), 4) AS {c}_coverage"


@query(f"WITH {_SNAP} SELECT count(*) AS source_chunks, count(DISTINCT stable_hash) AS chunks, {_SHARE('chunk_id')}, {_SHARE('document')}, {_SHARE('content')} FROM x")
def snapshot_summary(s, d):
    return go.snapshot_summary(_chunks(s, d))


@query(f"""WITH {_SNAP}, y AS (SELECT pos, coalesce(document, '<unknown>') AS document, coalesce(content, '') AS t, regexp_matches(coalesce(content, ''), '{go.TABLE_HINT}') AS tb FROM c),
l AS (SELECT pos, document, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: lower({sql_collapse('x')})), lambda x: regexp_matches(x, '\\||<t[hrd]'))[1:12], chr(10))[1:2000] AS g, lag(document) OVER (ORDER BY pos) AS before
  FROM y WHERE tb)
SELECT count(*) AS chunks, count(*) FILTER (tb) AS table_like, count(*) FILTER (regexp_matches(t, '{go.IMAGE_HINT}')
  AND trim(regexp_replace(t, '{go.IMAGE_HINT}', '', 'g')) = '') AS image_only,
  count(*) FILTER (regexp_matches(t, '{go.DELIMITER}')) AS delimiter_visible, max(length(t)) AS max_chars,
(SELECT count(*) FROM l WHERE before = document) AS split_tables, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM l WHERE g <> '' GROUP BY g)) AS duplicate_tables, CASE WHEN count(*) FILTER (tb) > 0 THEN count(DISTINCT document) FILTER (NOT tb) ELSE 0 END AS documents_without_tables FROM y""")
def snapshot_review(s, d):
    return go.snapshot_review(_chunks(s, d))


@query("""WITH j AS (SELECT DISTINCT item_id * 2 AS query_id FROM benchmark WHERE item_id % 3 > 0) SELECT 'query_without_qrels' AS code, 'error' AS severity, item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM j)
UNION ALL SELECT 'qrels_without_query', 'warning', query_id FROM j WHERE query_id NOT IN (SELECT item_id FROM benchmark)""")
def preflight(s, d):
    b = table(s, d, "benchmark")
    return go.preflight(b.select(F.col("item_id").alias("query_id")), b.select((F.col("item_id") * 2).alias("query_id"), (F.col("item_id") % 3).cast("double").alias("relevance")))


_NOW, _THEN = [("hit", 0.9), ("mrr", 0.5), ("map", 0.25), ("new", 1.0), ("zero", 0.5)], [("hit", 0.8), ("mrr", 0.5), ("map", 0.3), ("old", 1.0), ("zero", 0.0)]
_DELTA = f"""{values("n", "metric string, actual double", _NOW)}, t AS (SELECT * FROM (VALUES {', '.join(map(str, _THEN))}) AS v(metric, actual)), dl AS (SELECT metric, round(n.actual - t.actual, 6)::DOUBLE AS absolute, CASE WHEN t.actual <> 0 THEN round(round(n.actual - t.actual, 6) / abs(t.actual), 6) END::DOUBLE AS relative,
CASE WHEN round(n.actual - t.actual, 6) > 0 THEN 'up' WHEN round(n.actual - t.actual, 6) < 0 THEN 'down' ELSE 'same' END AS direction FROM n JOIN t USING (metric))"""


def _deltas(s):
    return me.metric_delta(s.createDataFrame(_NOW, "metric string, actual double"), s.createDataFrame(_THEN, "metric string, actual double"))


@query(f"WITH {_DELTA} SELECT * FROM dl")
def metric_delta(s, d):
    return _deltas(s)


@query(f"WITH {_DELTA} SELECT direction, count(*) AS n, array_to_string(list(metric ORDER BY metric), ',') AS metrics FROM dl GROUP BY 1")
def delta_report(s, d):
    return go.delta_report(_deltas(s)).withColumn("metrics", F.array_join("metrics", ","))


_DROPS = [("hit", "drop", 0.05), ("mrr", "drop", 0.0), ("map", "drop", 0.01), ("map", "min", 0.2), ("hit", "max", 0.5), ("absent", "drop", 0.1)]


@query(f"""WITH {_DELTA}, g AS (SELECT * FROM (VALUES {', '.join(map(str, _DROPS))}) AS v(metric, op, threshold)), a AS (SELECT metric, op, threshold, CASE op WHEN 'drop' THEN dl.absolute ELSE n.actual END::DOUBLE AS actual FROM g LEFT JOIN n USING (metric) LEFT JOIN dl USING (metric))
SELECT metric, op, threshold, actual, CASE op WHEN 'min' THEN actual >= threshold WHEN 'max' THEN actual <= threshold ELSE actual >= -threshold END AS passed FROM a WHERE actual IS NOT NULL""")
def gate_with_drops(s, d):
    return me.gate(s.createDataFrame(_NOW, "metric string, actual double"), s.createDataFrame(_DROPS, "metric string, op string, threshold double"), _deltas(s))


@query("SELECT k AS kind, q::BIGINT AS queries, c::BIGINT AS chunks, floor(least(0.99, CASE k WHEN 'bridge_term' THEN 0.25 WHEN 'source_boundary' THEN 0.82 WHEN 'allowed_tag_review' THEN 0.88 WHEN 'unexpected_tag' THEN 0.93 ELSE 0.75 END::DOUBLE + least(0.15, q * 0.03::DOUBLE) + least(0.1, c * 0.02::DOUBLE)) * 100 + 0.5 + 1e-9) / 100 AS risk FROM (VALUES ('bridge_term'), ('source_boundary'), ('allowed_tag_review'), ('unexpected_tag'), ('other')) a(k), range(0, 7) b(q), range(0, 7) e(c)")
def suppression_risk(s, d):
    kinds = s.createDataFrame([(k,) for k in [*go.RISK_BASE, "other"]], "kind string")
    grid = kinds.withColumn("queries", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long")))).withColumn("chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    return grid.withColumn("risk", go.suppression_risk(F.col("kind"), F.col("queries"), F.col("chunks")))


# --- tags over documents: names from sources and languages

_TAGS = [(1, "en"), (2, "EN"), (3, "de"), (4, "bad name"), (5, "x" * 65), (6, "web"), (7, "unused:1")]
_TAGSET = f"""{values("t", "pos long, name string", _TAGS)}, a AS (SELECT 'd' || doc_id AS path, [coalesce(lang, 'none'), coalesce(source, 'none')] AS tags FROM documents WHERE doc_id % 2 = 0), u AS (SELECT unnest(tags) AS name FROM a)"""


def _tagset(s, d):
    docs = table(s, d, "documents")
    path = F.concat(F.lit("d"), "doc_id").alias("path")
    return s.createDataFrame(_TAGS, "pos long, name string"), docs.where("doc_id % 2 = 0").select(path, F.array(F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none"))).alias("tags")), docs.select(path)


@query(f"""WITH {_TAGSET} SELECT 'tag_duplicate_name' AS code, 'warning' AS severity, name FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY pos) AS k FROM t) WHERE k > 1 UNION ALL SELECT 'tag_name_invalid', 'error', name FROM t WHERE NOT regexp_matches(name, '{go.TAG_NAME}')
UNION ALL SELECT 'assignment_orphan_tag', 'warning', name FROM u WHERE name NOT IN (SELECT name FROM t)""")
def lint_tagset(s, d):
    tags, assigned, _ = _tagset(s, d)
    return go.tagset_issues(tags, assigned)


@query(f"""WITH {_TAGSET} SELECT (SELECT count(DISTINCT name) FROM u) AS assigned_tags, (SELECT count(DISTINCT name) FROM t WHERE name NOT IN (SELECT name FROM u)) AS unused_tags, (SELECT count(DISTINCT name) FROM u WHERE name NOT IN (SELECT name FROM t)) AS orphan_tags,
(SELECT count(*) FROM documents WHERE doc_id % 2 <> 0) AS unassigned_documents""")
def tagset_report(s, d):
    return go.tagset_report(*_tagset(s, d))


# --- topology

_DOM = """dm AS (SELECT coalesce(source, 'unknown') AS domain, count(*) AS documents, sum(greatest(1, ceil(coalesce(length(text), 0) / 3000)))::BIGINT AS chunks, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY 1)"""


@query(f"WITH {_DOM} SELECT *, round(chunks / sum(chunks) OVER (), 4) AS chunk_share, round(chars / sum(chars) OVER (), 4) AS char_share FROM dm")
def domain_summary(s, d):
    return go.domains(table(s, d, "documents").withColumnRenamed("source", "domain"))


@query(f"WITH {_DOM} SELECT 'split-' || lpad(row_number() OVER (ORDER BY domain)::VARCHAR, 3, '0') || '-' || trim(regexp_replace(lower(domain), '[^a-z0-9]+', '-', 'g'), '-') AS id, domain, documents, chunks, chars, CASE WHEN documents >= 40 OR chunks >= 60 THEN 'standalone_kb_candidate' ELSE 'merge_or_stage_review' END AS action FROM dm")
def split_groups(s, d):
    return go.split_groups(table(s, d, "documents").withColumnRenamed("source", "domain"), 40, 60)


@query("SELECT count(*) AS documents, sum(length(text))::BIGINT AS chars, CASE WHEN count(*) >= 3 OR sum(length(text)) >= 1200 THEN 'sufficient' ELSE 'thin' END AS status FROM documents")
def min_corpus(s, d):
    return go.corpus_size(table(s, d, "documents"))


@query("""SELECT a, b, c, g, e, CASE WHEN a THEN 'split_before_upload' WHEN b AND c THEN 'merge' WHEN c AND g = 'low' THEN 'stage' ELSE 'create' END AS action, CASE WHEN a OR (b AND c) OR (c AND g = 'low') THEN 'medium' WHEN e AND NOT c THEN 'high' ELSE 'medium' END AS confidence
FROM (VALUES (true), (false)) v1(a), (VALUES (true), (false)) v2(b), (VALUES (true), (false)) v3(c), (VALUES ('low'), ('high')) v4(g), (VALUES (true), (false)) v5(e)""")
def topology_recommendation(s, d):
    both = lambda x, name: x.withColumn(name, F.explode(F.array(F.lit(True), F.lit(False))))
    t = both(both(both(both(s.range(1), "a"), "b"), "c"), "e").withColumn("g", F.explode(F.array(F.lit("low"), F.lit("high"))))
    return t.withColumn("r", go.recommendation(F.col("a"), F.col("b"), F.col("c"), F.col("g"), F.col("e"))).select("a", "b", "c", "g", "e", "r.action", "r.confidence")


# --- routes

_BASES = [(i, f"kb{i}", h) for i, h in enumerate([["the river", "water", ""], ["market", "price of", "wat"], ["der Wald", "und", "Market price"], ["la maison", "les", "e ri"]])]
_B = f"b0 AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}', {sql_list(h)})" for i, n, h in _BASES)}) AS v(pos, name, hints))"


@query(f"""WITH {_B}, h AS (SELECT pos, name, unnest(hints) AS hint FROM b0), g AS (SELECT *, lower(trim(hint)) AS k FROM h WHERE trim(hint) <> '')
SELECT x.name AS left, x.hint AS left_hint, y.name AS right, y.hint AS right_hint FROM g x JOIN g y ON x.pos < y.pos AND (contains(x.k, y.k) OR contains(y.k, x.k))""")
def hint_conflicts(s, d):
    return go.hint_conflicts(s.createDataFrame(_BASES, "pos int, name string, hints array<string>"))


_RT = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '{tx.TOKEN}'))"
_ROUTED = f"""{_B}, q AS (SELECT item_id AS query_id, lower(text) AS q, {_RT('text')} AS t FROM benchmark), sc AS (SELECT query_id, name, list_sum(list_transform(list_filter(hints, lambda x: trim(x) <> ''), lambda h: CASE WHEN contains(q, lower(h)) THEN 10.0 ELSE len(list_intersect(t, {_RT('h')})) END::DOUBLE))
  + CASE WHEN list_has_any(t, {_RT('name')}) THEN 0.5 ELSE 0 END + least(1.0, 0.25 *
    len(list_intersect(t, {_RT("array_to_string(hints, ' ')")}))) AS s FROM q, b0),
rt AS (SELECT query_id, max(s)::DOUBLE AS score, CASE WHEN max(s) > 0 THEN arg_max(name, {{'s': s, 'n': -ascii(name[3:3])}}) ELSE 'kb0' END AS selected, max(s) < 2 AS low_confidence FROM sc GROUP BY 1)"""


def _routed(s, d):
    bases = s.createDataFrame([(n, h, " ".join(h)) for _, n, h in _BASES], "name string, hints array<string>, description string")
    return cv.route(rg._questions(s, d).where("question IS NOT NULL"), bases, "kb0")


@query(f"WITH {_ROUTED} SELECT * FROM rt")
def route_questions(s, d):
    return _routed(s, d)


_CASES = f"{_ROUTED}, cs AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' ELSE '' END AS category, CASE WHEN query_id % 2 = 0 THEN 'en' END AS locale, CASE WHEN query_id % 5 = 0 THEN 'other' END AS negative_class, selected = 'kb' || query_id % 4 AS passed FROM rt)"


@query(f"""WITH {_CASES}, p AS (SELECT passed, unnest([{{'k': 'category', 'v': category}}, {{'k': 'locale', 'v': locale}}, {{'k': 'negative_class', 'v': negative_class}}]) AS b FROM cs)
SELECT b.k AS dimension, b.v AS value, count(*) AS total, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / count(*), 4) AS pass_rate FROM p WHERE coalesce(b.v, '') <> '' GROUP BY ALL""")
def route_tests(s, d):
    i = F.col("query_id")
    cases = _routed(s, d).select(F.when(i % 3 == 0, "easy").when(i % 3 == 1, "hard").otherwise("").alias("category"), F.when(i % 2 == 0, "en").alias("locale"), F.when(i % 5 == 0, "other").alias("negative_class"), (F.col("selected") == F.concat(F.lit("kb"), i % 4)).alias("passed"))
    return go.bucket_totals(cases)


# --- answers: each assistant turn, with the user turns of its conversation as evidence

_SENT = f"list_filter(list_transform(string_split(regexp_replace(t, '([。！？.!?]+)\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {sql_collapse('x')}), lambda x: length(x) >= 20)"
_TOKS = lambda c: sql_tokens(c, tx.EVIDENCE_STOPWORDS)


@query(f"""WITH a AS (SELECT conv_id || '-' || turn AS answer_id, conv_id, coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' See [1] and [9].' WHEN 1 THEN ' So [0].' ELSE '' END AS t FROM conversations WHERE role = 'assistant'),
e AS (SELECT conv_id, list_distinct(list(turn)) AS ranks, list_distinct(flatten(list({_TOKS("coalesce(text, '')")}))) AS terms FROM conversations
  WHERE role = 'user' GROUP BY 1),
j AS (SELECT answer_id, list_transform(regexp_extract_all(t, '\\[(\\d+)\\]', 1), lambda x: x::BIGINT) AS cited, coalesce(ranks, []) AS ranks,
  len(list_filter({_SENT}, lambda x: NOT regexp_matches(x, '\\[\\d+\\]') AND len({_TOKS('x')}) > 0 AND NOT list_has_any({_TOKS('x')},
  coalesce(terms, [])))) AS unsupported FROM a LEFT JOIN e USING (conv_id)),
k AS (SELECT answer_id, len(cited) AS citations, len(list_distinct(list_intersect(cited, ranks))) AS cited_evidence,
  len(list_distinct(list_filter(cited, lambda x: NOT list_contains(ranks, x)))) AS invalid, unsupported, len(ranks) AS evidence FROM j)
SELECT *, CASE WHEN invalid > 0 THEN 'FAIL' WHEN (evidence > 0 AND citations = 0) OR unsupported > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM k""")
def citation_audit(s, d):
    c = table(s, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    key = F.concat("conv_id", F.lit("-"), "turn")
    more = F.when(F.col("turn") % 3 == 0, " See [1] and [9].").when(F.col("turn") % 3 == 1, " So [0].").otherwise("")
    answers = c.where("role = 'assistant'").select(key.alias("answer_id"), "conv_id", F.concat("text", more).alias("text"))
    evidence = answers.select("answer_id", "conv_id").join(c.where("role = 'user'").select("conv_id", F.col("turn").alias("rank"), F.col("text").alias("preview")), "conv_id")
    return go.citation_audit(answers.drop("conv_id"), evidence.drop("conv_id"))


_POLL = lambda c: sql_tokens(c, tx.POLLUTION_STOPWORDS)


@query(f"""WITH {rg._hits_sql('h')}, x AS (SELECT query_id, coalesce(source, 'none') AS document, {_POLL("array_to_string(string_split(b.text, ' ')[1:12], ' ')")} AS own, {_POLL("array_to_string(string_split(b.text, ' ')[13:], ' ')")} AS more0, {_POLL("coalesce(dd.text, '') || ' ' || coalesce(source, 'none')")} AS found FROM h JOIN benchmark b ON b.item_id = query_id JOIN documents dd USING (doc_id)),
y AS (SELECT query_id, document, len(own) AS n,
  len(list_intersect(own, found)) AS o, list_intersect(list_filter(more0, lambda t: NOT list_contains(own, t)), found) AS e
  FROM x), m AS (SELECT query_id, max(k) AS most FROM (SELECT query_id, document, count(*) AS k FROM y GROUP BY ALL) GROUP BY 1),
g AS (SELECT query_id, count(*) AS hits, count(*) FILTER (len(e) > 0 AND o = 0) AS expansion_only, count(*) FILTER (len(e) > 0 AND round(CASE
  WHEN n > 0 THEN o / n ELSE 0 END, 4) < 0.25) AS low_coverage, array_to_string(list_sort(list_distinct(flatten(list(e)))), ',') AS bridge_terms
  FROM y GROUP BY 1)
SELECT g.*, hits >= 3 AND most * 2 >= hits AS source_dominance, CASE WHEN expansion_only > 0 OR low_coverage > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM g JOIN m USING (query_id)""")
def query_pollution(s, d):
    docs = table(s, d, "documents")
    words = F.split("question", " ", -1)
    hits = rg._hits(s, d).select("query_id", "doc_id", "rank").join(rg._questions(s, d), "query_id").join(docs.select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("document")), "doc_id")
    hits = hits.select("query_id", "rank", "document", F.coalesce("text", F.lit("")).alias("content"), F.slice(words, 13, 1 << 20).alias("expanded"), F.array_join(F.slice(words, 1, 12), " ").alias("question"))
    return go.pollution(hits).withColumn("bridge_terms", F.array_join("bridge_terms", ","))
