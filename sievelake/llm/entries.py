"""Queries of this subpackage, and their DuckDB statements: thin views over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import decontaminate
from .language import identify_languages
from .minhash import near_duplicates
from .mixing import mix_sources
from .quality import quality_report
from .secrets import find_secrets
from .sharding import assign_shards
from .substring_dedup import remove_repeated_passages
from .suffix_dedup import remove_repeated_bytes
from .url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(_table(spark, sf_dir, "documents"), 50)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents"), 50)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), 5, 75)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


#: Bytes of text in a shard, for the sharding query and the pipeline.
SHARD_BYTES = 1 << 20


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


#: Words that may stand between those of a window where it is near.
NEAR_SLOP = 5


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10, unnamed=True, slop=NEAR_SLOP).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (op1_substring_dedup, op2_quality_rules, op3_language_id, op4_suffix_array_dedup, op5_secret_scan, op6_minhash_near_dedup, op7_source_mixing, op8_url_filter, op9_extendible_sharding, op10_decontamination)
    return {f.__name__: f for f in all_of}


_OP1 = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_doc FROM x),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS g FROM f WHERE first_doc < doc_id GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN w ELSE
         list_filter(w, lambda v, k: NOT list_contains(g, k)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

_OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE
  len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT doc_id, i,
  count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_upper, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
v AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
      CASE WHEN n_words > 0 THEN least(100, 100 * n_symbols // n_words) ELSE 0 END AS symbol_score, CASE
        WHEN n_lines > 0 THEN least(100, 100 * n_dup_lines // n_lines) ELSE 0 END AS dup_line_score,
      CASE WHEN n_words > 0 THEN least(100, 100 * n_repeat_words // n_words) ELSE 0 END AS repeat_score, CASE
        WHEN word_chars > 0 THEN least(100, 100 * n_upper // word_chars) ELSE 0 END AS upper_score FROM m),
j AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT stratum, good, unnest([{'r': 'symbol_score', 's': symbol_score}, {'r': 'dup_line_score', 's': dup_line_score}, {'r': 'repeat_score', 's': repeat_score}, {'r': 'upper_score', 's': upper_score}]) AS x
      FROM v JOIN j USING (doc_id) WHERE NOT base_failed),
k AS (SELECT stratum, x.r AS rule, c, count(*) FILTER (good) AS n, count(*) FILTER (good AND x.s >= c) AS k, count(*) FILTER (NOT good
  AND x.s >= c) AS gain
      FROM h, (SELECT unnest(range(1, 101)) AS c) GROUP BY ALL),
s AS (SELECT stratum, max(n) AS n, count(*) OVER () AS strata FROM k GROUP BY stratum),
p AS (SELECT stratum, i, strata, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99))) OVER (PARTITION BY stratum
  ORDER BY i) AS tail
      FROM (SELECT stratum, n, strata, unnest(range(0, ceil(n * 0.01)::BIGINT + 1)) AS i FROM s)),
b AS (SELECT stratum, max(i) AS most FROM p WHERE tail <= 0.05 / (strata * 4) GROUP BY stratum),
cut AS (SELECT stratum, rule, arg_max(c, {'g': gain - k, 'c': c}) AS c FROM k JOIN b USING (stratum) WHERE k <= most AND gain > k
  GROUP BY stratum, rule),
x AS (SELECT stratum, max(c) FILTER (rule = 'symbol_score') AS c1, max(c) FILTER (rule = 'dup_line_score') AS c2, max(c) FILTER (rule = 'repeat_score') AS c3, max(c) FILTER (rule = 'upper_score') AS c4
  FROM cut GROUP BY stratum)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(symbol_score >= c1, false) OR coalesce(dup_line_score >= c2, false) OR coalesce(repeat_score >= c3, false) OR
         coalesce(upper_score >= c4, false)) AS kept
FROM v LEFT JOIN x USING (stratum)
"""

_OP4 = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
x AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_doc FROM x) WHERE first_doc < doc_id),
e AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + 50, true) AS new_span FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, span, min(i) AS lo, max(i) + 50 AS hi
      FROM (SELECT doc_id, i, sum(new_span::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e) GROUP BY doc_id, span),
g AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM s GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN los IS NULL THEN h ELSE
         array_to_string(list_transform(range(0, len(los) + 1), lambda k: substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE his[k] END) + 1,
           2 * ((CASE WHEN k = len(los) THEN length(h) // 2 ELSE los[k + 1] END) - (CASE WHEN k = 0 THEN 0
             ELSE his[k] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


_OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS g FROM d),
x AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS v FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.v = b.v AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT node, min(reached) AS c FROM r GROUP BY node)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.doc_id = c.node
"""

_OP7 = r"""
WITH c AS (SELECT coalesce(source, '<null>') AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT s, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM c),
p AS (SELECT s, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS p
      FROM (SELECT s, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r)),
a AS (SELECT s, list(p ORDER BY k) AS p FROM p GROUP BY s),
d AS (SELECT *, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, 1 + len(list_filter(p, lambda x: u >= x))))::INT AS copy
FROM d JOIN a ON a.s = coalesce(d.source, '<null>')
"""

_OP9 = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h,
  coalesce(strlen(text), 0) AS b FROM documents),
t AS (SELECT 0 AS depth, h, b FROM d
      UNION ALL
      SELECT depth + 1, h, b FROM (SELECT *, sum(b) OVER (PARTITION BY depth, h >> (60 - depth)) AS s, min(h) OVER q AS lo, max(h) OVER q AS hi FROM t
        WINDOW q AS (PARTITION BY depth, h >> (60 - depth))) WHERE s > 1048576 AND lo < hi AND depth < 60),
m AS (SELECT h, max(depth) AS depth FROM t GROUP BY h)
SELECT doc_id, text, lang, source, n_chars, CASE WHEN depth = 0 THEN ''
  ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS shard_id, depth::INT AS shard_depth,
       (sum(b) OVER (PARTITION BY depth, h >> (60 - depth)))::BIGINT AS shard_bytes,
         count(*) OVER (PARTITION BY depth, h >> (60 - depth)) AS shard_rows
FROM d JOIN m USING (h)
"""

_OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (SELECT item_id, least(10, len(w)) AS n, list_slice(w, i, i + 9) AS l, array_to_string(list_slice(w, i, i + 9), ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
x AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, item_id, i, n FROM x JOIN p USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h)
  GROUP BY doc_id),
y AS MATERIALIZED (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i FROM d),
f AS (SELECT v, count(*) AS n FROM y GROUP BY v),
q AS (SELECT item_id, l, u.n, arg_min(v, f.n) AS v FROM (SELECT item_id, l, n, unnest(l) AS v FROM (SELECT DISTINCT item_id, l, n FROM p)) u
  JOIN f USING (v) GROUP BY item_id, l, u.n),
o AS (SELECT doc_id, item_id, l, n, i, w FROM q JOIN y USING (v) JOIN d USING (doc_id)
  WHERE list_has_all(list_slice(w, greatest(1, i - n - 4), i + n + 4), l)),
g AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM (SELECT doc_id, item_id, l, list_slice(w, k, k + n + 4) AS a
  FROM (SELECT *, unnest(range(greatest(1, i - n - 4), i + 1)) AS k FROM o))
      WHERE len(list_filter(list_distinct(l), lambda t: len(list_filter(a, lambda z: z = t)) < len(list_filter(l, lambda z: z = t)))) = 0),
r AS (SELECT doc_id, count(*) AS n_near, string_agg(s, ',' ORDER BY s) AS near_ids FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
         coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id)
"""


#: Base spans only: no text of the tables holds a key or token that decodes, so all spans are base ones there.
_OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT * FROM (VALUES (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8),
      (1, 'access', 'AKIA[A-Z0-9]+', '(AKIA[A-Z0-9]+)', 16), (2, 'hex', '[0-9a-f]+', '([0-9a-f]+)', 32)) AS k(o, kind, p, g, least)),
m AS (SELECT r, o, kind, g, least, regexp_extract_all(t, p) AS m, string_split_regex(t, p) AS b FROM d, k WHERE o < 2
  OR regexp_matches(t, '[0-9a-f]{32}')),
s AS (SELECT r, o, kind, g, least, m[i] AS x, list_sum(list_transform(list_slice(b, 1, i), lambda v: length(v))) +
  coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda v: length(v))), 0) AS lo
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)),
f AS (SELECT r, o, kind, lo::BIGINT AS lo, kind || ':' || lo::BIGINT || ':' || (lo + length(x))::BIGINT AS v FROM s
  WHERE length(regexp_extract(x, g, 1)) >= least),
a AS (SELECT r, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2, string_agg(v, ','
  ORDER BY lo, o) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access,
  coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""

#: 60 rounds of both ranks, after which no share changes by more than 0.85 ** 60.
_OP8 = r"""
WITH RECURSIVE u AS MATERIALIZED (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)) AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, regexp_extract_all(coalesce(html, ''), '(?i)href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1) AS links
        FROM pages),
k AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS k(v, h, p)),
b AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM u JOIN k ON (host = h OR ends_with(host, '.' || h))
  AND starts_with(path, p) GROUP BY page_id),
j AS MATERIALIZED (SELECT u.*, b.rule, b.v FROM u LEFT JOIN b USING (page_id)),
hosts AS MATERIALIZED (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (v = 'allow')::DOUBLE AS t, count(*) FILTER (v = 'block')::DOUBLE AS d
  FROM j WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, lower(unnest(links)) AS dst FROM j),
ties AS (SELECT DISTINCT host AS src, regexp_extract(host, '^[^.]+\.([^.]+\..+)$', 1) AS dst FROM hosts
  WHERE regexp_matches(host, '^[^.]+\.([^.]+\..+)$')),
edges AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, log2(count(*) + 1.0) AS w FROM links WHERE src <> dst AND src <> ''
  AND dst <> '' GROUP BY ALL
      UNION ALL SELECT src, dst, 1.0 FROM ties UNION ALL SELECT dst, src, 1.0 FROM ties) GROUP BY ALL),
steps AS MATERIALIZED (SELECT src AS host, dst AS too, w / sum(w) OVER (PARTITION BY src) AS share, 't' AS kind FROM edges UNION ALL
  SELECT dst, src, w / sum(w) OVER (PARTITION BY dst), 'd' FROM edges),
r AS (SELECT 0 AS k, host, t, n AS nt, d, n AS nd FROM hosts
      UNION ALL
      SELECT k, host, sum(t), sum(nt), sum(d), sum(nd) FROM (
        SELECT 1 + (SELECT max(k) FROM r) AS k, host, 0.15 * t AS t, 0.15 * n AS nt, 0.15 * d AS d, 0.15 * n AS nd FROM hosts
        UNION ALL SELECT r.k + 1, too, CASE kind WHEN 't' THEN 0.85 * share * t ELSE 0 END, CASE kind WHEN 't' THEN 0.85 * share * nt ELSE 0 END,
          CASE kind WHEN 'd' THEN 0.85 * share * d ELSE 0 END, CASE kind WHEN 'd' THEN 0.85 * share * nd ELSE 0 END FROM r JOIN steps USING (host))
            WHERE k <= 60 GROUP BY k, host),
bad AS (SELECT host FROM (SELECT host, CASE WHEN nt > 0 THEN t / nt ELSE 0 END AS trust, CASE WHEN nd > 0 THEN d / nd ELSE 0 END AS distrust FROM r
  WHERE k = 60) WHERE distrust > trust AND 2 * distrust > 1)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": _OP1,
        "op2_quality_rules": _OP2,
        "op4_suffix_array_dedup": _OP4,
        "op5_secret_scan": _OP5,
        "op6_minhash_near_dedup": _OP6,
        "op7_source_mixing": _OP7,
        "op8_url_filter": _OP8,
        "op9_extendible_sharding": _OP9,
        "op10_decontamination": _OP10,
    }
