"""Operators of the subpackage: against SQL, brute force, held-out accuracy and odd rows."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievelake.llm import entries
from sievelake.llm.decontaminate import build_index, decontaminate, search_index
from sievelake.llm.language import identify_languages
from sievelake.llm.minhash import near_duplicates
from sievelake.llm.mixing import mix_sources
from sievelake.llm.quality import quality_report
from sievelake.llm.secrets import confirmed, find_secrets
from sievelake.llm.sharding import assign_shards
from sievelake.llm.substring_dedup import remove_repeated_passages
from sievelake.llm.suffix_dedup import remove_repeated_bytes
from sievelake.llm.url_filter import RULES, judge_urls, propagate

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, h string, rank int"
LONG = " ".join(f"word{i}" for i in range(20000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [(1, "one two three four five six seven eight nine ten " + PASSAGE, "en", "a", 9, 1, "x", 1), (2, "eleven " + PASSAGE + " twelve", "en", "a", 9, 1, "x", 1),
        (2, "eleven " + PASSAGE + " twelve", "en", "a", 9, 1, "x", 1), (3, None, None, None, None, None, None, None), (4, "", "de", "b", 0, 1, "x", 1),
        (5, " \n\t ", "de", "b", 3, 1, "x", 1), (6, LONG, "en", "a", 1, 1, "x", 1), (7, LONG, "en", None, 1, 1, "x", 1), (8, "ÄÖ 𝒳 é", "fr", "c", 1, 1, "x", 1)]
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"

OPERATORS = {
    "op1": lambda s, d: remove_repeated_passages(d, 50),
    "op2": lambda s, d: quality_report(d, s.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, 0)], LABELS)),
    "op3": lambda s, d: identify_languages(d),
    "op4": lambda s, d: remove_repeated_bytes(d, 50),
    "op5": lambda s, d: find_secrets(d),
    "op6": lambda s, d: near_duplicates(d, 5, 75),
    "op9": lambda s, d: assign_shards(d, 1000),
    "op10": lambda s, d: decontaminate(d, s.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "TWELVE"), (None, "eleven")], ITEMS), 10),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    got = OPERATORS[name](spark, spark.createDataFrame(ROWS, DOCS)).collect()
    assert len(got) == len(ROWS) and sorted(r.doc_id for r in got) == sorted(r[0] for r in ROWS)
    assert OPERATORS[name](spark, spark.createDataFrame([], DOCS)).count() == 0


def test_mixing_odd_rows(spark):
    out = mix_sources(spark.createDataFrame(ROWS, DOCS))
    assert {"text", "source", "rank"} <= set(out.columns) and out.where("copy < 1").count() == 0
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_planted_cases(spark):
    d = spark.createDataFrame(ROWS, DOCS).dropDuplicates(["doc_id"])
    removed = {r.doc_id: r.n_removed for r in OPERATORS["op1"](spark, d).collect()}
    assert (removed[1], removed[2], removed[6], removed[7]) == (0, 60, 0, 20000)
    kept = {r.doc_id: r.kept for r in OPERATORS["op6"](spark, d).collect()}
    assert kept[6] and not kept[7] and kept[1]
    hit = {r.doc_id: r.n_hit for r in OPERATORS["op10"](spark, d).collect()}
    assert (hit[1], hit[2], hit[6]) == (60, 61, 0)  # the item without an id is ignored


def test_decontaminate_stage_judges_rows(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE), (None, "only in an item without an id")], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "a " + PASSAGE), (None, "clean"), (1, PASSAGE + " b"), (1, "clean too"), (1, None), (2, "it is Only in an item without an ID"), (3, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(None, "clean"), (1, "clean too"), (1, None), (3, "clean")], key=str)


def test_items_without_an_id_as_in_sql(spark, tmp_path):
    con = duckdb.connect()
    items = [(1, PASSAGE), (None, "eleven"), (None, "TWELVE"), (12, "twelve"), (3, None)]
    spark.createDataFrame([r[:2] for r in ROWS if r[0] != 2] + [ROWS[1][:2]], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df, r = entries.queries()["op10_decontamination"](spark, str(tmp_path)), con.execute(entries.oracle_sql()["op10_decontamination"])
    cols = [c[0] for c in r.description]
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(r.fetchall())


@pytest.mark.parametrize("chunk_bytes", [1600, 16 << 20])
def test_chunks_of_the_benchmark_keep_repeated_rows(spark, chunk_bytes):
    rows = [(None, "x " + PASSAGE + " y"), (None, "x " + PASSAGE + " y"), (None, "y " + PASSAGE + " x"), (7, "clean"), (7, "clean"), (8, None)]
    index = build_index(spark.createDataFrame(spark.sparkContext.parallelize(3 * rows, 3), "doc_id long, text string"))
    assert index.count() == 3
    items = spark.createDataFrame([(1, PASSAGE), (2, "other words of the benchmark"), (None, "Y")], ITEMS)
    got = sorted(((r.doc_id, r.n_words, r.spans, r.items) for r in search_index(index, items, 10, chunk_bytes, unnamed=True).collect()), key=str)
    hit = [(None, 62, [1, 62], [1, None])] * 2 + [(None, 62, [0, 61], [1, None])]
    assert got == sorted(3 * (hit + [(7, 1, [], [])] * 2 + [(8, 0, [], [])]), key=str)
    assert len({(r.block, r.row) for r in search_index(index, items, 10, chunk_bytes).collect()}) == 18


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    df, r = entries.queries()[name](spark, DATA), con.execute(entries.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(r.description)}
    cols = sorted(df.columns)
    assert cols == sorted(at)
    assert sorted(str(tuple(x[c] for c in cols)) for x in df.collect()) == sorted(str(tuple(x[at[c]] for c in cols)) for x in r.fetchall())


def test_secrets_against_plain_patterns(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    extra = spark.createDataFrame([(10**6, f"API_KEY = 'abcdefgh1' secret:short AKIAABCDEFGHIJKL {'0af' * 12} {jwt}"), (10**6 + 1, None)], "doc_id long, text string")
    docs = texts.unionByName(extra)
    got = {r.doc_id: r for r in find_secrets(docs).collect()}
    for doc_id, text in docs.collect():
        spans = []
        for kind, p, ok in [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
                            ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)]:
            spans += [(m.start(), kind, m.end()) for m in re.finditer(p, text or "") if ok(m)]
        order = ["assign", "access", "hex"]
        line = ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], order.index(x[1]))))
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in spans) for k in order]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
    assert "jwt:" in got[10**6].spans


def test_every_der_key_of_a_hex_run():
    keys = ["30250201000420" + bytes(range(i, i + 32)).hex() for i in (100, 140)]
    for before in ("", "ab" * 200, "30" * 60 + "a", "9" * 33 + "30" + "f" * 97):
        text = "x " + before + keys[0] + "ff" * 50 + keys[1] + "ee" * 20 + " y"
        starts = [text.index(k) for k in keys]
        for t in (text, text.upper()):
            assert [x for x in confirmed(t) if x[0] == "der"] == [("der", s, s + 78) for s in starts]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_urls_against_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    more = [(10**6, None, None), (10**6 + 1, "no scheme", ""), (10**6 + 2, "http://X.NET/es/a?b", "<a href='//y.org/'>"), (10**6 + 3, "http://a.example.com/en/", None), (10**6 + 4, "http://www.example.com/en/x#y", None), (10**6 + 5, "http://", None)]
    both = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(more, "page_id long, url string, html string"))
    got = {r.page_id: r for r in judge_urls(both).collect()}
    for page_id, url, _ in both.collect():
        host, path, rule = brute_rule(url)
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")
    assert judge_urls(both.limit(0)).count() == 0


def verdicts(spark, rows):
    """Verdicts of pages, after a comparison of all rows with the statement."""
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", docs.toPandas())
    r = con.execute(entries.oracle_sql()["op8_url_filter"])
    cols = [c[0] for c in r.description]
    got = judge_urls(docs).select(cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, r.fetchall()))
    return {x.page_id: (x.rule, x.verdict) for x in got}


def test_links_to_blocked_hosts_spread_distrust(spark):
    rows = [(i, f"http://bad{i % 3}.net/es/{i}", "") for i in range(30)] + [(100, "http://farm.org/x", " ".join(f"<a href='http://bad{i}.net/'>" for i in range(3)))]
    rows += [(200 + i, f"http://good.com/{i}", "<a href='http://clean.org/'>") for i in range(30)] + [(300, "http://clean.org/x", "")]
    got = {k: v for k, (_, v) in verdicts(spark, rows).items()}
    assert got[100] == "block" and got[300] == "allow" and got[1] == "block" and got[200] == "allow"


def test_unruled_pages_of_mostly_blocked_hosts_are_blocked(spark):
    # More than half of all pages are blocked by rule; there are no links, only the tie of x.b.net to its parent.
    rows = [(i, f"http://a.net/{'es' if i % 10 else 'en'}/{i}", None) for i in range(40)]
    rows += [(100 + i, f"http://x.b.net/{'fr' if i % 5 else 'de'}/{i}", None) for i in range(20)] + [(200, "http://b.net/es/", None)]
    rows += [(300 + i, f"http://c.net/{'en' if i % 5 else 'es'}/{i}", None) for i in range(20)] + [(400 + i, f"http://d.org/{i}", None) for i in range(5)]
    got = verdicts(spark, rows)
    assert {got[i] for i in (0, 10, 20, 30, 100, 105, 110, 115)} == {(None, "block")}
    assert {got[300 + i] for i in range(20) if i % 5} | {got[400 + i] for i in range(5)} == {(None, "allow")}


def test_shares_are_those_of_dense_ranks(spark):
    seeds = [("a", 4, 0, 4), ("b", 2, 1, 0), ("c", 3, 0, 0), ("d", 5, 5, 0), ("e", 1, 0, 0), ("lone", 4, 1, 3)]
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("c", "d", 3.0), ("d", "e", 1.0), ("e", "d", 0.5)]
    names = [s[0] for s in seeds]
    w = np.zeros((6, 6))
    for a, b, x in edges:
        w[names.index(a), names.index(b)] = x
    step = lambda m: m / np.maximum(m.sum(1, keepdims=True), 1e-300)
    rank = lambda m, s: np.linalg.solve(np.eye(6) - 0.85 * step(m).T, np.array(s, float))
    n, t, d = zip(*(s[1:] for s in seeds), strict=True)
    want = dict(zip(names, zip(rank(w, t) / rank(w, n), rank(w.T, d) / rank(w.T, n), strict=True), strict=True))
    got = propagate(spark.createDataFrame(seeds, "host string, n long, t long, d long"), spark.createDataFrame(edges, "src string, dst string, w double")).collect()
    assert {r.host for r in got} == set(names)
    for r in got:
        assert abs(r.trust - want[r.host][0]) < 2e-3 and abs(r.distrust - want[r.host][1]) < 2e-3


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right / n >= 0.95
