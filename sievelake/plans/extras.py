"""Queries of records, sections, freezes and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import records as rc
from sievelake.functions import text as tx
from sievelake.operators import conversation as cv
from sievelake.operators import runtime as ru
from sievelake.operators import sections as se
from sievelake.operators import sets as st
from sievelake.plans import documents as dc
from sievelake.plans import registry as rg
from sievelake.plans import scalars as sc
from sievelake.plans.base import query, sql_collapse, sql_count, sql_list, table
from sievelake.plans.scalars import values

_URLS = [(i, x) for i, x in enumerate(["http://localhost:9380/api?x=1", "https://192.168.1.4/", "http://100.64.3.1", "http://127.0.0.9:80", "https://example.org/a/b", "http://box", "http://nas.local/x", "http://203.0.113.7", "http://8.8.8.8?q", "https://u:p@10.2.3.4:8443/v1", "", "nothing", "http://300.1.1.1/"])]
_IP = lambda a: f"(TRY_CAST(split_part({a}, '.', 1) AS BIGINT) * 16777216 + TRY_CAST(split_part({a}, '.', 2) AS BIGINT) * 65536 + TRY_CAST(split_part({a}, '.', 3) AS BIGINT) * 256 + TRY_CAST(split_part({a}, '.', 4) AS BIGINT))"
_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(\?[^#]*)?"
_NETS = lambda *n: "(" + " OR ".join(f"ip BETWEEN {a * 16777216 + b * 65536 + c * 256} AND {a * 16777216 + b * 65536 + c * 256 + s - 1}" for a, b, c, s in n) + ")"


@query(f"""WITH {values("w", "id long, url string", _URLS)}, p AS (SELECT id, lower(regexp_extract(url, '{_URL}', 1)) AS scheme, lower(regexp_extract(url, '{_URL}', 2)) AS h, regexp_extract(url, '{_URL}', 3) AS port, regexp_extract(url, '{_URL}', 4) AS path, regexp_extract(url, '{_URL}', 5) AS q FROM w),
n AS (SELECT *, CASE WHEN regexp_matches(h, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$')
  AND list_max(list_transform(string_split(h, '.'), lambda x: TRY_CAST(x AS INT))) <= 255 THEN {_IP('h')} END AS ip FROM p)
SELECT id, scheme, CASE WHEN h = '' THEN 'unknown' WHEN h = 'localhost' THEN 'local' WHEN {_NETS((127, 0, 0, 1 << 24))} THEN 'local'
  WHEN {_NETS((10, 0, 0, 1 << 24), (172, 16, 0, 1 << 20), (192, 168, 0, 1 << 16), (169, 254, 0, 1 << 16))} THEN 'lan'
  WHEN {_NETS((100, 64, 0, 1 << 22))} THEN 'vpn'
WHEN {_NETS((0, 0, 0, 1 << 24), (192, 0, 0, 256), (192, 0, 2, 256), (198, 18, 0, 1 << 17), (198, 51, 100, 256), (203, 0, 113, 256), (240, 0, 0, 1 << 28))} THEN 'private'
  WHEN ip IS NOT NULL THEN 'public' WHEN regexp_matches(h, '\\.(local|lan)$') THEN 'lan' WHEN NOT contains(h, '.') THEN 'hostname'
  ELSE 'public' END AS host_class,
TRY_CAST(nullif(port, '') AS INT) AS port, path NOT IN ('', '/') AS has_path, q <> '' AS has_query FROM n""")
def endpoints(s, d):
    return s.createDataFrame(_URLS, "id long, url string").select("id", rc.endpoint(F.col("url")).alias("e")).select("id", "e.*")


_SECRET_TEXTS = ["Authorization: Bearer abcdef123456 x", "GET /a?token=zzz&b=1&api_key=yy#f", "password = hunter2, secret:'x'", "my key is PLAIN-LITERAL and PLAIN", "nothing"]
_RED = [(p, n.replace("$1", "\\1").replace("$2", "\\2")) for _, p, n in rc.REDACTIONS]
_R = lambda i: "t" if i == 0 else f"regexp_replace({_R(i - 1)}, '{_RED[i - 1][0].replace(chr(39), chr(39) * 2)}', '{_RED[i - 1][1]}', 'g')"
_TEXTS = "d AS (SELECT doc_id + 1000 AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, {dc._str(x)})" for i, x in enumerate(_SECRET_TEXTS)) + ") AS v(id, t))"


@query(f"""WITH {_TEXTS} SELECT id, sha256(replace(replace({_R(3)}, 'PLAIN-LITERAL', '<redacted:secret>'), 'PLAIN', '<redacted:secret>')) AS redacted_sha256, {', '.join(f"len(regexp_extract_all({_R(i)}, '{_RED[i][0].replace(chr(39), chr(39) * 2)}')) AS {rc.REDACTIONS[i][0]}" for i in range(3))} FROM d""")
def redacted_texts(s, d):
    own = s.createDataFrame(list(enumerate(_SECRET_TEXTS)), "id long, t string")
    t = table(s, d, "documents").select((F.col("doc_id") + 1000).alias("id"), F.coalesce("text", F.lit("")).alias("t")).unionByName(own)
    r = t.select("id", rc.redacted(F.col("t"), ["PLAIN", "PLAIN-LITERAL", ""]).alias("r"))
    return r.select("id", F.sha2(F.encode("r.text", "UTF-8"), 256).alias("redacted_sha256"), *(f"r.{n}" for n, _, _ in rc.REDACTIONS))


@query("""SELECT event_id, round(value * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 60000 ELSE 1 END, 3) AS ms, CASE WHEN event_id % 3 > 0 AND value > 0 THEN round(event_id % 3 / (value / 1000), 3) END AS items_per_second, CASE WHEN event_id % 3 > 0 AND value > 0 THEN round(value / (event_id % 3), 3) END AS ms_per_item FROM events""")
def durations(s, d):
    i = F.col("event_id")
    unit = F.when(i % 4 == 0, "MS").when(i % 4 == 1, "s").when(i % 4 == 2, "min").otherwise("?")
    e = table(s, d, "events").select("event_id", rc.duration_ms(F.col("value"), unit).alias("ms"), se.throughput(i % 3, F.col("value")).alias("t"))
    return e.select("event_id", "ms", "t.*")


_EST = f"CASE WHEN t = '' THEN 0 ELSE greatest(1, ceil(length(f) / (CASE WHEN {sql_count('f', tx.CJK)} >= greatest(1, length(f) // 8) THEN 2.0 ELSE 4.0 END))) END"


@query(f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t, {sql_collapse("coalesce(text, '')")} AS f, doc_id % 90 AS r, doc_id % 7 AS c FROM documents), e AS (SELECT doc_id, greatest({_EST}, r * c * 4, r * greatest(c, 1) * 3)::BIGINT AS estimate FROM x)
SELECT doc_id, estimate, least(4096, greatest(1024, (estimate + 511) // 512 * 512))::BIGINT AS recommended FROM e""")
def table_tokens(s, d):
    i = F.col("doc_id")
    r, c = i % 90, i % 7
    return table(s, d, "documents").select("doc_id", rc.table_tokens(r, c, r * c, F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", "t.*")


_CMP = "regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '(?im)^[ \\t]*<!--[ \\t]*chunk[ \\t]*-->[ \\t]*$', chr(10), 'g'), '!\\[([^\\]]*)\\]\\([^)]+\\)', '![\\1](<image>)', 'g')"


@query(f"WITH {dc._D} SELECT id, sha256(array_to_string(list_filter(list_transform(string_split({_CMP}, chr(10)), lambda x: {sql_collapse('x')}), lambda x: x <> ''), chr(10))) AS comparable_sha256 FROM d")
def comparable_texts(s, d):
    return dc._docs(s, d).select("id", F.sha2(F.encode(rc.comparable(F.col("t")), "UTF-8"), 256).alias("comparable_sha256"))


_CONF = [(1, {"a": "1", "b": "2"}, {"a": "1", "b": "2"}), (2, {"a": "1", "c": "x"}, {"a": "2", "b": "2"}), (3, {}, {"z": "1"})]


@query("SELECT * FROM (VALUES (1, '', '', '', false), (2, 'c', 'b', 'a', true), (3, '', 'z', '', true)) AS v(id, missing, extra, changed, drift)")
def config_diffs(s, d):
    c = s.createDataFrame(_CONF, "id long, r map<string,string>, e map<string,string>").select("id", rc.config_diff(F.col("r"), F.col("e")).alias("x")).select("id", "x.*")
    return c.select("id", *(F.array_join(k, ",").alias(k) for k in ("missing", "extra", "changed")), "drift")


@query("""SELECT label, count(*) AS kb_count, CASE WHEN label IS NULL THEN 'not_configured' WHEN label % 3 = 0 THEN 'not_configured' WHEN label % 3 = 1 THEN 'match' ELSE 'mismatch' END AS drift FROM embeddings GROUP BY label""")
def embedding_models(s, d):
    e = table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("kb_count"))
    model = F.concat(F.lit("Model-"), F.col("label") % 3)
    expected = F.when(F.col("label") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("MODEL-1")))
    return e.select("label", "kb_count", rc.embedding_drift(model, expected).alias("drift"))


# --- sections: sentences of documents as lines, some of them headings and page marks

_LINED = """replace(replace(coalesce(text, ''), '. ', '.' || chr(10)), ', ', chr(10) || '# ')"""
_LN = f"""s0 AS (SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -1, 'page 3' || chr(10) || 'a 1.5 b 20%' || chr(10) || '## H x' || chr(10) || '<!-- page: 7 -->' || chr(10) || 'c 3,000' || chr(10) || '# I'),
s1 AS (SELECT doc_id, string_split(regexp_replace({_LINED}, '\\n\\z', ''), chr(10)) AS r
  FROM s0), ln AS MATERIALIZED (SELECT doc_id, i AS line, t AS text, last_value(coalesce(nullif(regexp_extract(t, '{se.PAGE_COMMENT}', 1), ''), nullif(regexp_extract(t, '{se.PAGE_TEXT}', 1), ''))::BIGINT IGNORE NULLS) OVER (PARTITION BY doc_id
  ORDER BY i) AS page
FROM (SELECT doc_id, unnest(r) AS t, unnest(range(1, len(r) + 1)) AS i FROM s1))"""


def _lined(s, d):
    own = s.createDataFrame([(-1, "page 3\na 1.5 b 20%\n## H x\n<!-- page: 7 -->\nc 3,000\n# I")], "doc_id long, text string")
    docs = table(s, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).unionByName(own)
    t = F.replace(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit(", "), F.lit("\n# "))
    return se.line_rows(docs.select("doc_id", t.alias("text")))


@query(f"""WITH {_LN}, n AS (SELECT doc_id, max(line) AS n FROM ln GROUP BY 1), h AS (SELECT doc_id, trim(regexp_extract(text, '{se.HEADING}', 2)) AS title, length(regexp_extract(text, '{se.HEADING}', 1)) AS level, line AS line_start, page AS page_start FROM ln WHERE regexp_matches(text, '{se.HEADING}')),
u AS (SELECT * FROM h UNION ALL SELECT doc_id, '', 0, 1, page FROM ln WHERE line = 1 AND doc_id NOT IN (SELECT doc_id FROM h))
SELECT doc_id, title, level, line_start, coalesce(lead(line_start) OVER (PARTITION BY doc_id ORDER BY line_start) - 1, n) AS line_end, page_start FROM u JOIN n USING (doc_id)""")
def section_bounds(s, d):
    return se.sections(_lined(s, d))


@query(f"""WITH {_LN}, v AS (SELECT doc_id, line, unnest(m) AS value, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, line, regexp_extract_all(text, '{se.NUMBER}') AS m FROM ln WHERE NOT regexp_matches(text, '{se.PAGE_COMMENT}') AND NOT regexp_matches(text, '{se.PAGE_TEXT}')))
SELECT doc_id, nth, line, trim(value) AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, i) AS nth FROM v) WHERE nth <= 20""")
def numeric_candidates(s, d):
    return se.numbers(_lined(s, d))


@query(f"""WITH {dc._D}, r AS (SELECT id, unnest(x) AS t, unnest(range(1, len(x) + 1)) AS i FROM (SELECT id, {dc._LINES} AS x FROM d)), m AS (SELECT id, regexp_matches(t, '(?i)^\\s*<!--\\s*chunk\\s*-->\\s*$') AS m, lead(regexp_matches(t, '(?i)^\\s*<!--\\s*chunk\\s*-->\\s*$')) OVER (PARTITION BY id ORDER BY i) AS nx FROM r WHERE trim(t) <> ''),
c AS (SELECT id, count(*) FILTER (m) AS markers, count(*) AS n, count(*) FILTER (m AND coalesce(nx, false)) AS consecutive, count(*) FILTER (m AND
  coalesce(nx, true)) AS empty_sections FROM m GROUP BY 1)
SELECT id AS doc_id, markers, round(markers / n, 4) AS density, markers = 0 AND n >= 12 AS sparse, round(markers / n, 4) > 0.3 AS dense, consecutive, empty_sections FROM c""")
def marker_density(s, d):
    return se.marker_warnings(dc._docs(s, d).select(F.col("id").alias("doc_id"), F.col("t").alias("text")))


_SPLIT = "CASE WHEN length(x) <= 120 THEN [x] ELSE list_transform(list_filter(string_split(regexp_replace(x, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p) <> ''), lambda p: regexp_replace(trim(p)[1:120], '\\s+$', '')) END"


@query(f"""WITH x AS (SELECT doc_id AS pos, coalesce(source, 'none') AS source, regexp_replace(replace(coalesce(text, ''), ', ', chr(10) || '# '), '\\r\\n?', chr(10), 'g') AS t FROM documents),
l AS (SELECT pos, source, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''
  AND NOT regexp_matches(x, '^[#!]') AND NOT regexp_matches(x, '^[-*_=\\s]{{3,}}$') AND NOT regexp_matches(x, '^\\|?[\\s:|.-]+\\|?$')) AS r FROM x),
p AS (SELECT pos, source, flatten(list_transform(r, lambda x: {_SPLIT})) AS v FROM l), u AS (SELECT pos, source, unnest(v) AS span, unnest(range(1,
  len(v) + 1)) AS i FROM p),
f AS (SELECT source, lower(span) AS k, arg_min(span, {{'p': pos, 'i': i}}) AS span, min(pos) AS pos FROM u WHERE length(span) >= 20 GROUP BY ALL)
SELECT source, pos, span, CASE WHEN len(regexp_extract_all(span, '[A-Za-z][A-Za-z0-9_-]{{2,}}|[\\x{{4E00}}-\\x{{9FFF}}]{{2,}}')) > 0 THEN array_to_string(regexp_extract_all(span, '[A-Za-z][A-Za-z0-9_-]{{2,}}|[\\x{{4E00}}-\\x{{9FFF}}]{{2,}}')[1:5], ' ')[1:80] ELSE 'the cited evidence' END AS topic FROM f""")
def qa_candidates(s, d):
    t = F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit("\n# "))
    return se.evidence_candidates(table(s, d, "documents").select(F.col("doc_id").alias("pos"), F.coalesce("source", F.lit("none")).alias("source"), t.alias("text")), 20, 120)


# --- freezes, runs, layers, names


@query("SELECT * FROM (VALUES ('a', true), ('b', false), ('c', false)) AS v(part, same)")
def split_freeze(s, d):
    docs, bench = table(s, d, "documents"), table(s, d, "benchmark")
    old = se.freeze("held-out", {"a": docs, "b": bench})
    return se.verify(old, se.freeze("held-out", {"a": docs.repartition(7), "b": bench.withColumn("text", F.concat("text", F.lit(" "))), "c": bench}))


@query(f"""WITH {rg._TWO}, x AS (SELECT query_id, count(*) AS n, arg_min(doc_id, rank) AS t FROM a GROUP BY 1), y AS (SELECT query_id, count(*) AS n, arg_min(doc_id, rank) AS t FROM b GROUP BY 1)
SELECT count(*) AS queries, count(*) FILTER (x.t = y.t) AS same_first, round(count(*) FILTER (x.t = y.t) / count(*), 4) AS top1_stability, round(avg(coalesce(y.n, 0) - coalesce(x.n, 0)), 4) AS mean_hit_delta, count(*) FILTER (y.n IS NULL) AS lost, count(*) FILTER (x.n IS NULL) AS gained FROM x FULL JOIN y USING (query_id)""")
def compare_runs(s, d):
    u = rg._two_runs(s, d)
    return se.compare_runs(u.where("source = 'a'"), u.where("source = 'b'"))


_TIES = [("q", "b", 1.0, 0.2), ("q", "a", 1.0, None), ("q", "c", 1.0, 0.9), ("q", "d", 2.0, None), ("r", "b", 0.0, 0.1), ("r", "a", 0.0, 0.3), ("s", "b", 1.0, 0.5), ("s", "a", 1.0, None)]
_TIE = "query_id string, name string, score double, cosine double"


@query(f"""WITH {values("t", _TIE, _TIES)}, c AS (SELECT *, score > 0 AND count(cosine) OVER (PARTITION BY query_id, score) >= 2 AS by_centroid FROM t)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE WHEN by_centroid THEN cosine END DESC NULLS LAST, name) AS place FROM c""")
def centroid_ties(s, d):
    return se.tie_break(s.createDataFrame(_TIES, _TIE))


_LAY = """l AS (SELECT 'path' AS layer, doc_id AS path, 'lang' AS key, coalesce(lang, 'none') AS value FROM documents UNION ALL SELECT 'handoff', doc_id, 'lang', 'en' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'user', doc_id, 'owner', 'u' FROM documents WHERE doc_id % 3 = 0)"""


@query(f"""WITH {_LAY} SELECT path, key, arg_max(value, CASE layer WHEN 'path' THEN 1 WHEN 'handoff' THEN 2 ELSE 3 END) AS value, arg_max(layer, CASE layer WHEN 'path' THEN 1 WHEN 'handoff' THEN 2 ELSE 3 END) AS layer, count(DISTINCT value) > 1 AS conflict FROM l GROUP BY ALL""")
def metadata_merge(s, d):
    docs = table(s, d, "documents")
    layer = lambda name, key, value, on: docs.where(on).select(F.lit(name).alias("layer"), F.col("doc_id").alias("path"), F.lit(key).alias("key"), value.alias("value"))
    rows = layer("path", "lang", F.coalesce("lang", F.lit("none")), "true").unionByName(layer("handoff", "lang", F.lit("en"), "doc_id % 2 = 0")).unionByName(layer("user", "owner", F.lit("u"), "doc_id % 3 = 0"))
    return se.merge_layers(rows, ["path", "handoff", "user"])


@query("SELECT * FROM (VALUES ('kb.a', 'exact'), ('kb.a(1)', 'suffix'), ('kb.a(22)', 'suffix')) AS v(name, kind)")
def name_collisions(s, d):
    return se.name_collisions(s.createDataFrame([(n,) for n in ("kb.a", "kb.a(1)", "kb.a(22)", "kbxa", "kb.a(x)", "kb.a (1)", "KB.A")], "name string"), "kb.a")


@query("""WITH c AS (SELECT item_id, 't' || item_id % 3 AS ty, item_id % 2 AS nc, item_id % 5 AS nt, item_id % 4 AS nq, item_id % 10 = 0 AS ng, item_id % 7 AS dd FROM benchmark)
SELECT count(*) AS queries, round(avg((nc > 0)::INT), 4) AS chunk_coverage, round(avg((nt > 0)::INT), 4) AS term_coverage,
  count(DISTINCT ty) AS types, count(DISTINCT dd) AS documents,
round(avg((nc > 0)::INT) * 0.4 + avg((nt > 0)::INT) * 0.2 + least(count(DISTINCT dd), 3) / 3 * 0.15 + least(count(DISTINCT ty), 4) / 4 * 0.1 + count(*) FILTER (nq > 0) / count(*) * 0.1 + avg(ng::INT) * 0.05, 4) AS score FROM c""")
def benchmark_strength(s, d):
    i = F.col("item_id")
    c = table(s, d, "benchmark").select(i.alias("query_id"), F.concat(F.lit("t"), i % 3).alias("query_type"), (i % 2).alias("n_chunks"), (i % 5).alias("n_terms"), (i % 4).alias("n_qa"), (i % 10 == 0).alias("negative"), F.array((i % 7).cast("string")).alias("documents"))
    return se.strength(c)


@query("""WITH a AS (SELECT source, lang FROM documents WHERE doc_id % 2 = 0), b AS (SELECT source, lang FROM documents WHERE doc_id % 2 = 1)
SELECT coalesce(source, '') || '/' || coalesce(lang, '') AS pair, greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0)::BIGINT AS surplus FROM (SELECT source, lang, count(*) AS n FROM a GROUP BY ALL) x LEFT JOIN (SELECT source, lang, count(*) AS n FROM b GROUP BY ALL) y USING (source, lang) WHERE coalesce(x.n, 0) > coalesce(y.n, 0)""")
def multiset_difference(s, d):
    docs = table(s, d, "documents")
    side = lambda on: docs.where(on).select("source", "lang")
    return st.surplus(side("doc_id % 2 = 0"), side("doc_id % 2 = 1")).select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit(""))).alias("pair"), "surplus")


# --- sessions


@query(f"""WITH q AS (SELECT conv_id, turn, {sql_collapse("coalesce(text, '')")} AS f FROM conversations), i AS (SELECT conv_id, turn, {sc._INTENT} AS intent FROM q)
SELECT conv_id, turn, intent, CASE intent WHEN 'clarification_needed' THEN 'clarification' WHEN 'out_of_scope' THEN 'rejected' ELSE 'retrieval_planned' END AS status,
CASE intent WHEN 'clarification_needed' THEN 'ask_clarifying_question' WHEN 'out_of_scope' THEN 'reject_or_redirect' WHEN 'comparison' THEN 'retrieve_and_compare' ELSE 'retrieve' END AS action,
intent IN ('comparison', 'knowledge_query') AS should_retrieve FROM i""")
def route_intents(s, d):
    return cv.intent_routes(table(s, d, "conversations")).select("conv_id", "turn", "intent", "status", "action", "should_retrieve")


_COST = f"""CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 0 ELSE greatest(1, {sql_count("coalesce(text, '')", tx.CJK)} + {sql_count("coalesce(text, '')", '[A-Za-z0-9_]+')}) END"""


@query(f"""WITH t AS (SELECT conv_id, turn, role, {sql_collapse("coalesce(text, '')")} AS f, {_COST} AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
b AS (SELECT a.conv_id, a.turn, p.role, p.f, p.i, sum(p.cost) OVER (PARTITION BY a.conv_id, a.turn ORDER BY p.i DESC) AS running FROM t a JOIN t p ON a.conv_id = p.conv_id AND p.i < a.i AND p.i >= a.i - 8),
k AS (SELECT conv_id, turn, coalesce(arg_max(f, i) FILTER (role = 'user'), arg_max(f, i)) AS anchor FROM b WHERE running <= 400 GROUP BY ALL),
n AS (SELECT t.conv_id, t.turn, f, anchor, len({sc._TOKENS}) AS n, list_has_any({sc._TOKENS}, {sql_list(cv.REFERENCES)}) OR contains(lower(f), 'above') OR contains(lower(f), 'previous')
  OR contains(lower(f), 'earlier') AS refers, regexp_matches(lower(f), '{cv.STARTER}') AS starts FROM t LEFT JOIN k USING (conv_id, turn) WHERE role = 'user'),
x AS (SELECT *, (n <= 6 AND (refers OR starts)) OR (starts AND n <= 8) AS needs FROM n)
SELECT conv_id, turn, needs AS needs_context, needs AND anchor IS NOT NULL AS context_applied, needs AND anchor IS NULL AS requires_clarification,
CASE WHEN needs AND anchor IS NOT NULL THEN f || ' Context: ' || anchor ELSE f END AS question FROM x""")
def session_enrich(s, d):
    return cv.enriched(table(s, d, "conversations"))


_STAGES = "MAP {" + ", ".join(f"'{k}': {{'s': '{a}', 'c': '{b}'}}" for k, (a, b) in ru.STAGE_NAMES.items()) + "}"
_KEY = lambda c: f"translate(lower(trim(coalesce({c}, ''))), '- ', '__')"


@query(f"""WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Wait Parse' WHEN 1 THEN 'retrieve' WHEN 2 THEN '' WHEN 3 THEN 'My-Stage' WHEN 4 THEN 'x' END AS stage, CASE event_id % 4 WHEN 0 THEN 'upload-markdown' WHEN 1 THEN ' ' END AS operation,
  CASE WHEN event_id % 3 = 0 THEN 'query' END AS included_in, CASE WHEN event_id % 11 = 0 THEN -value ELSE value END AS ms FROM events),
n AS (SELECT event_id, included_in, ms, coalesce(nullif(trim(stage), ''), 'unspecified') AS st, coalesce(nullif(trim(operation), ''), nullif(trim(stage), ''), 'unspecified') AS op FROM e),
p AS (SELECT *, coalesce(({_STAGES})[{_KEY('st')}], ({_STAGES})[{_KEY('op')}], {{'s': {_KEY('st')}, 'c': 'other'}}) AS k FROM n)
SELECT event_id, CASE WHEN k.s = 'retrieval' AND included_in = 'query' THEN 'query' ELSE k.s END AS standard_stage, k.c AS category, CASE WHEN ms >= 0 THEN round(ms, 3) END AS duration_ms, coalesce(ms >= 0, false) AS counted FROM p""")
def stage_timings(s, d):
    i = F.col("event_id")
    stage = F.when(i % 6 == 0, "Wait Parse").when(i % 6 == 1, "retrieve").when(i % 6 == 2, "").when(i % 6 == 3, "My-Stage").when(i % 6 == 4, "x")
    operation = F.when(i % 4 == 0, "upload-markdown").when(i % 4 == 1, " ")
    t = table(s, d, "events").select("event_id", stage.alias("stage"), operation.alias("operation"), F.lit(None).cast("string").alias("status"),
                                     F.when(i % 11 == 0, -F.col("value")).otherwise(F.col("value")).alias("duration_ms"), F.when(i % 3 == 0, "query").alias("included_in"))
    return ru.normalize_timings(t).select("event_id", "standard_stage", "category", "duration_ms", "counted")
