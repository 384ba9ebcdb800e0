"""HTML, tables, cleaning and segments: literal cases and brute force."""

import random

import duckdb
from pyspark.sql import functions as F

from sievelake.functions import cleaning, html, labels, markdown, rewrite
from sievelake.plans import registry


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_html_to_markdown(spark):
    got = html.to_markdown("<html><head><style>x{}</style><script>var a='</p>';</script></head><body><h2>T &amp; U</h2><p>a <b>b</b> <i>c</i><br>d <a href='/x'>e</a> <a>f</a></p><ol><li>1<li>2</ol><ul><li>z</li></ul><code>k</code></body></html>")
    assert got == "## T & U\n\na **b***c*\nd [e](/x)[f]\n\n1. 1\n\n1. 2\n\n- z\n\n`k`\n"
    assert html.to_markdown("") == html.to_markdown("<p> </p>") == ""
    assert html.to_markdown("<noscript><p>x</p></noscript>y<script>z") == "y\n"
    assert one(spark, None, html.markdown_of) is None and one(spark, "<h1>a</h1>", html.markdown_of) == "# a\n"


def test_page_titles_as_in_sql(spark, tmp_path):
    titles = ["token = &quot;a&quot;", "a &amp;amp; b", "&amp;quot;", "# x", "#", "", " ", "\u00a0\u3000x\u00a0", "a\n\t b\x0bc", "<b>x</b>", "a</title><title>b", "é" * 30, "x\u2028", "&lt;p&gt; &#65;"]
    pages = [f"<head><title>{t}</title></head><h1>h</h1><p>p" for t in titles] + ["<h1>no title</h1>", "<title>open", "<TITLE>x</TITLE>y", "<title lang='en'>x</title>y", "<!--<title>c</title>--><title>d</title>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["page_titles"]).fetchall()
    assert sorted(map(tuple, registry.queries()["page_titles"](spark, str(tmp_path)).collect())) == sorted(want)


def test_html_tables_and_warnings(spark):
    text = "```\n<table><tr><td>no</td></tr></table>\n```\n<table><caption> A  cap </caption><thead><tr><th>h1</th><th colspan='2'>h2</th></tr></thead><tr><td rowspan=2>a<br>b</td><td>c</td></tr></table> x </table><table><tr><td>1"
    got = one(spark, text, html.html_table_facts)
    a, b = got["tables"]
    assert (a["row_count"], a["column_count"], a["cell_count"], a["rowspan_count"], a["colspan_count"], a["header_depth"], a["caption"]) == (2, 3, 4, 1, 1, 1, "A cap")
    assert a["header_preview"] == ["h1", "h2"] and a["warnings"] == ["column_misalignment_suspected"]
    assert b["warnings"] == ["header_missing"] and not got["balanced"]
    assert one(spark, "<table></table>", html.html_table_facts)["tables"][0]["warnings"] == ["empty_table", "header_missing"]
    wide = "<table>" + "<tr>" + "<td>x</td>" * 13 + "</tr></table>"
    assert "large_table" in html.table_facts(html.html_tables(wide)[0][0])["warnings"]
    assert html._span({"colspan": "500"}, "colspan") == 100 and html._span({"colspan": "x"}, "colspan") == 1


def test_matrices(spark):
    assert html.split_row(r"| a \| b | c\\| d |") == [r"a \| b", r"c\\", "d"]
    text = "x\n| a | b |\n|---|:-:|\n| 1 |  2  |\n\n```\n| n | o |\n|---|---|\n```\n| w |\n| - |\n| p | q |\n|---|---|\n"
    assert [(h, r) for h, r in html.pipe_tables(text)] == [(["a", "b"], [["1", "2"]])]
    nested = "<table><thead><tr><th rowspan=2>k</th><th colspan=2>g</th></tr><tr><th>x</th><th>y</th></tr></thead><tr><td>1</td><td colspan=2>2</td></tr></table>"
    assert html.expanded(html.html_tables(nested)[0][0]) == (["k", "g / x", "g / y"], [["1", "2", "2"]])
    got = one(spark, nested, html.html_matrices)
    assert got[0]["sha256"] == html.matrix_sha256(["k", "g / x", "g / y"], [["1", "2", "2"]])


def test_cleaning_leaves_tables_and_code_alone(spark):
    table = "| x , y | ( z |\n|---|---|\n| 中 文 | ﬁ |\n"
    got = one(spark, "a , b\n" + table + "\n㐀 㐁 ( c )  ﬁ\n", lambda t: cleaning.clean_profile(t, "ocr"))
    assert got == "a, b\n" + table + "\n㐀㐁 (c)  fi\n"
    code = "```\n#no\n```\n#yes\n~~~\n#no"
    assert one(spark, code, lambda t: cleaning.clean(t, "heading")) == "```\n#no\n```\n# yes\n~~~\n#no"
    images = "![a](./img/x y.png \"T\") ![b](C:\\w\\images\\p.png) ![c](https://e.org/./a) ![d](<./q r.png> t) ![e](x.png) ![f](./././y.png)"
    want = "![a](img/x y.png \"T\") ![b](images/p.png) ![c](https://e.org/./a) ![d](<q r.png> t) ![e](x.png) ![f](y.png)"
    assert one(spark, images, lambda t: cleaning.clean(t, "images")) == want and one(spark, images, lambda t: cleaning.change_count(t, "images")) == 4
    assert one(spark, "", lambda t: cleaning.clean_profile(t, "safe")) == "" and one(spark, "\u0001b x", lambda t: cleaning.clean_profile(t, "ocr")) == "\u0001b x\n"


def brute_segments(text, soft, hard, least):
    rows = text.splitlines(keepends=True)
    cuts, start, i = [0], 0, 0
    cut = None
    while i < len(rows):
        size = sum(map(len, rows[start:i]))
        bare = rows[i].strip()
        if i > start and size >= least and (bare.startswith("# ") or bare == "<!-- chunk -->"):
            cut = i
        size += len(rows[i])
        if size >= soft and cut is not None:
            start, cut = cut, None
            cuts.append(start)
        elif size >= hard:
            start, cut = i + 1, None
            cuts.append(start)
        i += 1
    return [c for c in cuts if c < max(1, len(rows))]


def test_segments_against_brute_force(spark):
    rnd = random.Random(4)
    texts = ["", "a", "a\n"]
    for _ in range(40):
        texts.append("\n".join(rnd.choice(["# h", "<!-- chunk -->", "x" * rnd.randrange(0, 60), "y z", ""]) for _ in range(rnd.randrange(1, 60))) + rnd.choice(["", "\n"]))
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in df.select("i", markdown.segment_starts(F.col("t"), 120, 200, 40).alias("s"), markdown.segments(F.col("t"), 120, 200, 40).alias("p")).collect():
        assert r.s == brute_segments(texts[r.i], 120, 200, 40), texts[r.i]
        assert "\n".join(p["text"] for p in r.p) == texts[r.i].removesuffix("\n")


def test_labels_and_rewrites(spark):
    refs = one(spark, "A" * 64, labels.references)
    assert sorted(refs) == ["a" * 64, "sha256:" + "a" * 64] and one(spark, " c1 ", labels.references) == ["c1"] and one(spark, "", labels.references) == []
    assert one(spark, "How do I reset the API?", lambda t: rewrite.rewrite_plan(t, "simple")) == ["How do I reset the API?", "How do I reset the API", "how to reset the api"]
    assert one(spark, "Where is the config", lambda t: rewrite.rewrite_plan(t, "translate", F.array(F.lit("WHERE is  the config"), F.lit("new")))) == ["Where is the config", "Where is the config 配置", "new"]
