"""Queries of labels, rewrites, statuses and scores: over the tables, or over rows stated here where the tables have none such."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sievelake.functions import labels as lb
from sievelake.functions import rewrite as rw
from sievelake.functions import text as tx
from sievelake.operators import conversation as cv
from sievelake.operators import hits as hi
from sievelake.operators import scores as sc
from sievelake.plans.base import query, sql_collapse, sql_count, sql_list, table


def _sql(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(_sql, v)) + "]"
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A WITH member of literal rows; ``columns`` is a schema of ``name kind`` pairs."""
    kinds = {"string": "VARCHAR", "double": "DOUBLE", "long": "BIGINT", "boolean": "BOOLEAN"}
    pairs = [c.strip().split(" ") for c in columns.split(",")]
    body = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
    return f"{name} AS (SELECT {', '.join(f'{c}::{kinds[k]} AS {c}' for c, k in pairs)} FROM (VALUES {body}) AS v({', '.join(c for c, _ in pairs)}))"


# --- rewrites and complexity of the turns of conversations

_Q = f"q AS (SELECT conv_id, turn, {sql_collapse("coalesce(text, '')")} AS f FROM conversations)"
_BARE = "trim(regexp_replace(f, '[?.!。！？]+$', ''))"
_SHORT = ", ".join(f"CASE WHEN trim(regexp_replace(lower(b), '{p}', '{n}')) NOT IN ('', lower(b)) THEN trim(regexp_replace(lower(b), '{p}', '{n}')) END" for p, n in rw.OPENINGS)
_TOK = f"regexp_extract_all(b, '{tx.TOKEN}')"
_ONCE = "list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i)"


def _questions(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", tx.collapse(F.coalesce("text", F.lit(""))).alias("f"))


@query(f"""WITH {_Q}, b AS (SELECT *, {_BARE} AS b FROM q),
v AS (SELECT conv_id, turn, list_filter([f, CASE WHEN b <> '' AND b <> f THEN b END, {_SHORT}, CASE WHEN len({_TOK}) BETWEEN 2
  AND 8 THEN array_to_string({_TOK}, ' ') END], lambda x: x IS NOT NULL) AS v FROM b)
SELECT conv_id, turn, array_to_string({_ONCE}, '|') AS queries, len({_ONCE}) AS n_queries FROM v""")
def rewrite_plan(s, d):
    q = _questions(s, d).withColumn("p", rw.rewrite_plan(F.col("f"), "simple"))
    return q.select("conv_id", "turn", F.array_join("p", "|").alias("queries"), F.size("p").cast("long").alias("n_queries"))


_WORDS = [(1, "Which config and API source?"), (2, "nothing known here"), (3, "勒迈特 said documents, Documents"), (4, "勒迈特"), (5, "route  the　query")]
_DICT = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in rw.TERMS.items()) + "}"


@query(f"""WITH {values("w", "id long, text string", _WORDS)}, f AS (SELECT id, {sql_collapse('text')} AS f FROM w UNION ALL SELECT 100 + item_id, {sql_collapse("coalesce(text, '')")} FROM benchmark),
t AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(lower(f), '[0-9A-Za-z_]+|[\\x{{4E00}}-\\x{{9FFF}}]+'), lambda x: ({_DICT})[x]), lambda x: x IS NOT NULL)) AS t0,
  list_filter(list_transform(regexp_extract_all(lower(f), '[0-9A-Za-z_]+|[\\x{{4E00}}-\\x{{9FFF}}]+'), lambda x: ({_DICT})[x]), lambda x: x IS NOT NULL) AS ts
    FROM f),
u AS (SELECT *, list_filter(ts, lambda x, i: list_position(ts, x) = i) AS u FROM t)
SELECT id, CASE WHEN len(u) > 0 THEN f || ' ' || array_to_string(u, ' ') END AS translated, CASE WHEN contains(f, '勒迈特') THEN replace(f, '勒迈特', 'Lemaître') || '|' || replace(f, '勒迈特', 'Lemaitre') ELSE '' END AS names FROM u""")
def rewrite_translations(s, d):
    own = s.createDataFrame(_WORDS, "id long, text string")
    bench = table(s, d, "benchmark").select((F.col("item_id") + 100).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    f = own.unionByName(bench).withColumn("f", tx.collapse(F.col("text")))
    return f.select("id", F.get(rw.translated_variants(F.col("f")), F.lit(0)).alias("translated"), F.array_join(rw.name_variants(F.col("f")), "|").alias("names"))


_MARKS = " + ".join(f"regexp_matches(lower(f), '{p}')::INT" for p in rw.COORDINATION)
_TOKENS = f"regexp_extract_all(lower(f), '{tx.TOKEN}')"
_INTENT = f"""CASE WHEN len({_TOKENS}) <= 4 AND (list_has_any({_TOKENS}, {sql_list(cv.PRONOUNS)}) OR lower(f) IN ('what about it?', 'how about it?')) THEN 'clarification_needed'
  WHEN regexp_matches(lower(f), '{cv.CURRENT.replace("'", "''")}') THEN 'out_of_scope' WHEN regexp_matches(lower(f), '{cv.COMPARISON}') THEN 'comparison' ELSE 'knowledge_query' END"""
_PLAN = f"""{_Q}, i AS (SELECT conv_id, turn, f, {_INTENT} AS intent, len({_TOKENS}) AS tokens, {_MARKS} AS markers, {sql_count('f', '[?？]')} AS question_marks FROM q),
c AS (SELECT *, CASE WHEN intent IN ('clarification_needed', 'out_of_scope') THEN 'simple' WHEN tokens > 28 OR markers >= 3 OR question_marks > 1 THEN 'complex' WHEN intent = 'comparison' OR tokens > 12 OR markers > 0 THEN 'moderate' ELSE 'simple' END AS complexity FROM i)"""


def _intents(s, d):
    return cv.intents(_questions(s, d).withColumnRenamed("f", "text"))


@query(f"WITH {_PLAN} SELECT conv_id, turn, intent, tokens, markers, question_marks, complexity FROM c")
def query_complexity(s, d):
    q, t = _intents(s, d), F.col("text")
    return q.select("conv_id", "turn", "intent", F.size(tx.token_list(t)).cast("long").alias("tokens"), rw.markers(t).cast("long").alias("markers"),
                    F.regexp_count(t, F.lit("[?？]")).cast("long").alias("question_marks"), rw.complexity(t, F.col("intent")).alias("complexity"))


_TRIM = "trim(regexp_replace(trim(x), '{v}', ''), ' ,.;:!?')".replace("{v}", rw.VERBS)


@query(f"""WITH {_PLAN}, p AS (SELECT *, list_filter(list_transform(list_transform(string_split_regex(f, '{rw.PARTS}'), lambda x: {_TRIM}), lambda y: upper(y[1:1]) || y[2:]), lambda z: len(regexp_extract_all(lower(z), '{tx.TOKEN}')) >= 2) AS p0, regexp_replace(f, '[?.!]+$', '') AS b FROM c),
p1 AS (SELECT *, list_concat(p0, CASE WHEN intent = 'comparison' AND len(p0) < 2 THEN [b || ' key criteria', b || ' differences'] ELSE [] END) AS p1
  FROM p),
v AS (SELECT *, list_transform(list_concat(p1, CASE WHEN contains(lower(f), 'pros and cons')
  AND NOT list_bool_or(list_transform(list_concat(p1, ['x']), lambda x: contains(lower(x), 'pros'))) THEN [b || ' advantages', b || ' disadvantages']
  ELSE [] END), lambda x: {sql_collapse('x')}) AS v FROM p1)
SELECT conv_id, turn, CASE WHEN complexity = 'simple' THEN '' ELSE array_to_string(({_ONCE})[1:4], '|') END AS subqueries FROM v""")
def subqueries(s, d):
    return _intents(s, d).select("conv_id", "turn", F.array_join(rw.subqueries(F.col("text"), F.col("intent")), "|").alias("subqueries"))


# --- labels

_LABELS = [(i, x) for i, x in enumerate(["Table value", "fact", "Mixed-Modality", "screenshot ", "image/png", "text/plain", "Visual", "MD", "caption", "multimodal x", "", None, "other", "Numeric Row", "diagram", "my_table.csv", "é"])]
_NAME = "trim(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '_')"
_CATS = "MAP {" + ", ".join(f"'{a}': '{n}'" for n, x in lb.CATEGORY_NAMES.items() for a in x) + "}"
_CATM = "MAP {" + ", ".join(f"'{n}': '{','.join(x)}'" for n, x in lb.CATEGORY_MODALITIES.items()) + "}"
_MODAL = f"""CASE WHEN regexp_matches({_NAME}, 'mixed|multimodal') THEN 'mixed' WHEN starts_with(lower(trim(text)), 'image/') OR regexp_matches({_NAME}, '{lb.IMAGE_WORDS}') THEN 'image' WHEN contains({_NAME}, 'table') THEN 'table'
  WHEN starts_with(lower(trim(text)), 'text/') OR {_NAME} IN ({', '.join(map(_sql, lb.TEXT_NAMES))}) THEN 'text' END"""


@query(f"""WITH {values("w", "id long, text string", _LABELS)}, l AS (SELECT id, text, ({_CATS})[{_NAME}] AS category, {_MODAL} AS modality FROM w)
SELECT id, category, coalesce(({_CATM})[category], '') AS category_modalities, modality, CASE modality WHEN 'mixed' THEN 'image,mixed,table' ELSE
  coalesce(modality, '') END AS expected, CASE WHEN coalesce({_NAME}, '') = '' THEN 'uncategorized' ELSE {_NAME} END AS test_category,
CASE WHEN coalesce(trim(text), '') = '' THEN 'default' ELSE text END AS query_type FROM l""")
def modality_labels(s, d):
    t = F.col("text")
    w = s.createDataFrame(_LABELS, "id long, text string")
    return w.select("id", lb.category(t).alias("category"), F.array_join(lb.category_modalities(lb.category(t)), ",").alias("category_modalities"), lb.modality(t).alias("modality"),
                    F.array_join(lb.expected_modalities(t), ",").alias("expected"), lb.test_category(t).alias("test_category"), lb.query_type(t, F.lit(None).cast("string")).alias("query_type"))


_SECRET = " OR ".join(f"regexp_matches(t, '{p}')" for p in lb.SECRETS)


@query(f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT *, {sql_count('t', tx.CJK)} AS cjk, {sql_count('t', '[A-Za-z]')} AS latin FROM x)
SELECT doc_id, CASE WHEN cjk >= greatest(8, latin // 2) THEN 'zh' WHEN latin > 0 THEN 'en'
  ELSE 'unknown' END AS language, {_SECRET} AS holds_secret, {' OR '.join(f"contains(lower(trim(t)), {_sql(p)})" for p in lb.ABSTENTIONS)} AS abstained,
trim(regexp_replace(lower(t[1:60]), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM l""")
def document_labels(s, d):
    t = F.coalesce("text", F.lit(""))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.substring(t, 1, 60)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return table(s, d, "documents").select("doc_id", lb.text_language(t).alias("language"), lb.holds_secret(t).alias("holds_secret"), lb.abstained(t).alias("abstained"), slug.alias("slug"))


_HINTS = [(i, x) for i, x in enumerate(["API", "RTX4090", "deepSeek", "go lang", "a much longer hint", "数据", "", "e.g.", "tax guide", "GPU v", "manual_zh.pdf", "report-cn", "guide.en", "中文手册", "chen"])]


@query(f"""WITH {values("w", "id long, text string", _HINTS)}, t AS (SELECT id, trim(text) AS f, lower(text) AS n FROM w)
SELECT id, CASE WHEN NOT regexp_matches(f, '[A-Za-z]') OR regexp_matches(f, '{tx.CJK}') THEN NULL
  WHEN regexp_matches(f, '[A-Za-z][0-9]|[0-9][A-Za-z]|[+.#/:_-]') OR regexp_matches(f, '[a-z][A-Z]') THEN 'product_term'
WHEN length(regexp_replace(f, '[^A-Za-z]+', '', 'g')) BETWEEN 1 AND 5 AND
  len(list_distinct(regexp_extract_all(lower(f), '{tx.TOKEN}'))) = 1 THEN 'acronym' WHEN length(f) <= 8 AND
  len(list_distinct(regexp_extract_all(lower(f), '{tx.TOKEN}'))) <= 2 THEN 'short_english_name' END AS risk,
CASE WHEN regexp_matches(n, '(^|[^a-z0-9])(cn|zh|zho|chinese|ch)([^a-z0-9]|$)') OR contains(n, '中文') THEN 'zh' WHEN regexp_matches(n, '(^|[^a-z0-9])(en|eng|english)([^a-z0-9]|$)') THEN 'en' END AS file_language FROM t""")
def hint_labels(s, d):
    w = s.createDataFrame(_HINTS, "id long, text string")
    return w.select("id", lb.word_risk(F.col("text")).alias("risk"), lb.file_language(F.col("text")).alias("file_language"))


# --- raw hits and statuses

_RAW = [
    {"data": {"chunks": [{"content": "a b", "similarity": 0, "score": 0.5, "id": "c1", "docnm_kwd": "", "document_name": "n.md", "important_keywords": "  one "}, {"text": "t", "similarity": 0.25, "kb_id": 7, "dataset_id": "ds", "important_kwd": ["x", "y"]}]}},
    {"data": {"chunks": [], "docs": [{"page_content": "p", "content": "", "doc_id": "d9", "score": "0.75"}]}}, [{"content_with_weight": "w", "content": "c", "chunk_id": "k"}, 5, "x"], {"results": [{"doc_name": "z", "similarity": None}]}, {"data": {}}, {"data": None, "docs": [{"id": "only"}]},
]
_RAWS = [(i, json.dumps(x)) for i, x in enumerate(_RAW)]
_STR = lambda k: f"CASE WHEN json_type(h, '$.{k}') = 'VARCHAR' THEN nullif(h->>'$.{k}', '') END"
_FIRST = lambda c: "coalesce(" + ", ".join(_STR(k) for k in hi.ALIASES[c]) + ", NULL)"
_NUM = lambda k: f"TRY_CAST(h->>'$.{k}' AS DOUBLE)"
_ARR = lambda k: f"CASE json_type(h, '$.{k}') WHEN 'ARRAY' THEN nullif(array_to_string((h->'$.{k}')::VARCHAR[], '|'), '') WHEN 'VARCHAR' THEN nullif(trim(h->>'$.{k}'), '') END"
_HAS = lambda k: f"WHEN json_type(d, '$.{k}') = 'ARRAY' AND json_array_length(d, '$.{k}') > 0 THEN (d->'$.{k}')::JSON[]"


@query(f"""WITH {values("r", "query_id long, response string", _RAWS)}, t AS (SELECT query_id, CASE WHEN json_type(response::JSON, '$.data') IS NOT NULL THEN response::JSON->'$.data' ELSE response::JSON END AS d FROM r),
l AS (SELECT query_id, CASE WHEN json_type(d) = 'ARRAY' THEN d::JSON[] {' '.join(_HAS(k) for k in hi.LISTS)} ELSE [] END AS a
  FROM t), x AS (SELECT query_id, unnest(a) AS h, unnest(range(1, len(a) + 1)) AS rank FROM l)
SELECT query_id, rank, coalesce({_FIRST('content')}, '') AS content,
  coalesce(nullif({_NUM('similarity')}, 0), {_NUM('score')}) AS similarity, {', '.join(f'{_FIRST(c)} AS {c}' for c in hi.ALIASES if c != 'content')},
coalesce({_ARR('important_keywords')}, {_ARR('important_kwd')}, '') AS important_keywords FROM x WHERE json_type(h) = 'OBJECT'""")
def normalize_hits(s, d):
    return hi.normalize(s.createDataFrame(_RAWS, "query_id long, response string")).withColumn("important_keywords", F.array_join("important_keywords", "|"))


_STATES = [(1, 3, 0.5, 0.4, None, None, False, False), (2, 3, 0.1, 0.1, None, None, False, False), (3, 3, 0.1, None, None, None, None, None), (4, 3, 0.5, 0.1, None, None, False, False), (5, 0, None, None, None, None, False, False),
           (6, 3, 0.9, 0.9, " Needs_Clarification", "x", True, True), (7, 3, 0.9, 0.9, "reject", None, False, False), (8, 0, None, None, None, "Read timed out", False, False), (9, 0, None, None, "other", "boom", False, True), (10, 3, 0.9, 0.9, None, None, False, True), (11, 3, None, None, None, None, True, False), (12, None, None, None, "", "TIMEOUT", None, None), (13, 2, 0.1, 0.5, None, None, False, False)]
_STATE = "id long, n long, similarity double, evidence double, intent string, error string, timed_out boolean, partial boolean"


@query(f"""WITH {values("r", _STATE, _STATES)} SELECT id, CASE WHEN lower(trim(coalesce(intent, ''))) IN ('clarification', 'clarification_needed', 'needs_clarification') THEN 'clarification' WHEN lower(trim(coalesce(intent, ''))) IN ('rejected', 'reject', 'out_of_scope') THEN 'rejected'
WHEN coalesce(timed_out, false) OR coalesce(regexp_matches(lower(error), 'timed out|timeout'), false) THEN 'timeout' WHEN error IS NOT NULL THEN 'error' WHEN coalesce(partial, false) THEN 'partial' WHEN coalesce(n, 0) = 0 THEN 'empty'
WHEN similarity < 0.15 AND (evidence IS NULL OR evidence < 0.2) THEN 'low_quality' WHEN evidence < 0.2 THEN 'needs_refinement' ELSE 'success' END AS status FROM r""")
def retrieval_status_all(s, d):
    c = {x: F.col(x) for x in ("n", "similarity", "evidence", "intent", "error", "timed_out", "partial")}
    return s.createDataFrame(_STATES, _STATE).select("id", hi.status(*c.values()).alias("status"))


# --- scores

_PROFILES = [("a", 0.9, 0.95, 0.8, 0.7, 0.0, 120.0, 0.4, 40), ("b", 0.8, 0.9, 0.85, 0.75, 0.05, 900.0, None, 25), ("c", 1.0, 0.9, 0.8, None, 0.0, None, 0.2, 0), ("d", 0.9, 0.95, 0.8, 0.7, 0.0, 120.0, 0.4, 40)]
_PROFILE = "profile_id string, pass_rate double, hit_rate double, mrr double, ndcg_at_k double, empty_result_rate double, query_latency_ms double, cost_usd double, query_count long"
_PSCORE = f"""{values("p", _PROFILE, _PROFILES)}, z AS (SELECT profile_id, query_count, coalesce(pass_rate, 0) AS ps, coalesce(hit_rate, 0) AS hr, coalesce(mrr, 0) AS mr, coalesce(ndcg_at_k, 0) AS ng, coalesce(empty_result_rate, 0) AS er, least(coalesce(query_latency_ms, 0) / 10000, 0.05) AS lp,
CASE WHEN cost_usd > 0 AND query_count <= 0 THEN least(cost_usd * 0.1::DOUBLE, 0.05) WHEN cost_usd > 0 THEN least(cost_usd / query_count * 20, 0.05)
  ELSE 0 END AS cp FROM p),
s AS (SELECT profile_id, query_count, round(lp, 6) AS latency_penalty, round(cp, 6) AS cost_penalty, round((hr + mr + ng) / 3, 6) AS benchmark_quality, round(ps * 0.38::DOUBLE + hr * 0.25::DOUBLE + mr * 0.2::DOUBLE + ng * 0.12::DOUBLE - er * 0.05::DOUBLE - lp - cp, 6) AS score FROM z)"""


def _profiles(s):
    return sc.profile_scores(s.createDataFrame(_PROFILES, _PROFILE))


@query(f"WITH {_PSCORE} SELECT *, rank() OVER (ORDER BY score DESC) AS place FROM s")
def profile_scores(s, d):
    return _profiles(s).select("profile_id", "query_count", "latency_penalty", "cost_penalty", "benchmark_quality", "score", "place")


@query(f"""WITH {_PSCORE}, t AS (SELECT count(*) AS profiles, max(query_count) AS queries, list(profile_id ORDER BY score DESC, profile_id) AS w, list(score ORDER BY score DESC, profile_id) AS v FROM s)
SELECT profiles, queries, w[1] AS winner, round(v[1] - coalesce(v[2], 0), 6) AS score_delta, CASE WHEN profiles < 2 OR queries < 20 THEN 'insufficient_sample_for_default_change' WHEN round(v[1] - coalesce(v[2], 0), 6) < 0.03 THEN 'tie_or_no_default_change' ELSE 'recommend_default_change' END AS status FROM t""")
def profile_decision(s, d):
    return sc.profile_decision(_profiles(s))


_CANDIDATES = [(1, 0.9, 0.9, 0.8, 0.7, 0.5, 1.0, 0.0, 0.9, 120.0, 1000.0, 0.0), (2, 0.9, 0.9, 0.8, 0.7, 0.5, 1.0, 0.0, 0.9, None, 900.0, 2.0), (3, 1.2, 0.9, 0.4, None, 0.0, 0.0, 0.1, 0.9, 80.0, None, 4.0), (4, 0.2, 0.9, 0.1, 0.1, 0.0, 0.0, 1.0, 0.9, 400.0, 5000.0, 1.0)]
_CANDIDATE = "candidate_index long, pass_rate double, hit_rate double, mrr double, ndcg_at_k double, strict_chunk_recall_at_k double, expected_chunk_hit_rate double, empty_result_rate double, recall_at_k double, query_latency_ms double, parse_time_ms double, enrichment_weight double"
_C01 = lambda c: f"least(1, greatest(0, coalesce({c}, 0)))"
_CSCORE = f"""{values("c", _CANDIDATE, _CANDIDATES)}, m AS (SELECT *, greatest(0, {' + '.join(f'{_C01(c)} * {w}::DOUBLE' for c, w in sc.CANDIDATE_WEIGHTS.items()).replace('+ least(1, greatest(0, coalesce(empty', '+ least(1, greatest(0, coalesce(empty')}) AS b,
CASE WHEN query_latency_ms IS NULL THEN 0.025 ELSE round(query_latency_ms / max(query_latency_ms) OVER () * 0.05::DOUBLE, 4) END + CASE
  WHEN parse_time_ms IS NULL THEN 0.025 ELSE round(parse_time_ms / max(parse_time_ms) OVER () * 0.05::DOUBLE, 4) END +
  round(enrichment_weight / max(enrichment_weight) OVER () * 0.04::DOUBLE, 4) AS k FROM c),
s AS (SELECT *, round({_C01('b')}, 4) AS pre_cost_score, round(k, 4) AS cost_penalty, round({_C01('b - k')}, 4) AS score FROM m),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, enrichment_weight, query_latency_ms NULLS LAST, parse_time_ms NULLS LAST, candidate_index) AS place FROM s), w AS (SELECT * FROM r WHERE abs(pre_cost_score - (SELECT pre_cost_score FROM r WHERE place = 1)) <= 1e-9)"""


def _candidates(s):
    return sc.ranked(sc.candidate_scores(s.createDataFrame(_CANDIDATES, _CANDIDATE)))


@query(f"WITH {_CSCORE} SELECT candidate_index, pre_cost_score, cost_penalty, score, place, candidate_index IN (SELECT candidate_index FROM w) AS co_winner FROM r")
def candidate_scores(s, d):
    placed = _candidates(s)
    won = sc.co_winners(placed).select("candidate_index", F.lit(True).alias("co_winner"))
    return placed.join(won, "candidate_index", "left").select("candidate_index", "pre_cost_score", "cost_penalty", "score", "place", F.coalesce("co_winner", F.lit(False)).alias("co_winner"))


@query(f"""WITH {_CSCORE}, t AS (SELECT count(*) AS n, max((enrichment_weight > 0 AND (query_latency_ms IS NULL OR parse_time_ms IS NULL))::INT) AS u FROM w)
SELECT n AS co_winners, (SELECT round(max(score) FILTER (place = 1) - max(score) FILTER (place = 2), 4) FROM r) AS score_delta, CASE WHEN n > 1 AND u = 1 THEN 'needs_cost_review' WHEN n > 1 THEN 'co_winners' ELSE 'recommended' END AS status FROM t""")
def experiment_decision(s, d):
    return sc.decision(_candidates(s), "promotable")


@query(f"WITH {values('c', _CANDIDATE, _CANDIDATES)} SELECT unnest(['hit_rate', 'mrr', 'recall_at_k']) AS metric, unnest([count(DISTINCT coalesce(hit_rate, 0)) = 1, count(DISTINCT coalesce(mrr, 0)) = 1, count(DISTINCT coalesce(recall_at_k, 0)) = 1]) AS saturated FROM c")
def metric_saturation(s, d):
    return sc.saturation(s.createDataFrame(_CANDIDATES, _CANDIDATE))


@query("SELECT k::BIGINT AS k, array_to_string(list_sort(list_distinct([k, greatest(k + 1, ceil(k * 1.5)::BIGINT), least(greatest(k + 2, k * 2), 20)])), ',') AS candidates FROM range(1, 31) AS r(k)")
def top_k_candidates(s, d):
    return s.range(1, 31).select(F.col("id").alias("k"), F.array_join(sc.top_k_candidates(F.col("id")), ",").alias("candidates"))


@query("""WITH g AS (SELECT a, b, c, row_number() OVER (ORDER BY a, b, c) AS i FROM (VALUES (0), (2), (4)) x(a), (VALUES (false), (true)) y(b), (VALUES ('naive'), ('general')) z(c))
SELECT a, b, c, i FROM (SELECT *, min(i) OVER (PARTITION BY a * b::INT, c) AS f FROM g) WHERE i = f""")
def experiment_grid(s, d):
    one = lambda name, kind, xs: s.createDataFrame([(x,) for x in xs], f"{name} {kind}")
    key = F.concat_ws("|", (F.col("a") * F.col("b").cast("int")).cast("string"), "c")
    return sc.grid({"a": one("a", "int", [0, 2, 4]), "b": one("b", "boolean", [False, True]), "c": one("c", "string", ["naive", "general"])}, key)
