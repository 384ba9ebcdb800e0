"""Lines of documents as rows: pages, sections, numbers, markers; freezes of row sets; runs compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import markdown as md
from sievelake.functions import records as rc

# Patterns of pages, headings and numbers.
PAGE_COMMENT = r"(?i)<!--\s*(?:page|page_id|page-id|page_index|page-index)\s*[:=]?\s*(\d+)\s*-->"
PAGE_TEXT = r"(?i)^\s*(?:page|p\.|第)\s*([0-9]{1,5})\s*(?:页)?\s*$"
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
NUMBER = r"\d+(?:[.,]\d+)*\s*%?"


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text, page): lines from 1, the page being that of the last marker up to the line."""
    rows = docs.select("doc_id", F.posexplode(md.lines(F.col("text"))).alias("i", "t")).select("doc_id", (F.col("i") + 1).cast("long").alias("line"), "t")
    found = F.coalesce(F.nullif(F.regexp_extract("t", PAGE_COMMENT, 1), F.lit("")), F.nullif(F.regexp_extract("t", PAGE_TEXT, 1), F.lit(""))).cast("long")
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("page", F.last(found, ignorenulls=True).over(upto)).withColumnRenamed("t", "text")


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, title, level, line_start, line_end, page_start) of the headings; a document without one is one section of level 0."""
    last = lines.groupBy("doc_id").agg(F.max("line").alias("n"))
    h = lines.where(F.col("text").rlike(HEADING)).select("doc_id", F.trim(F.regexp_extract("text", HEADING, 2)).alias("title"), F.length(F.regexp_extract("text", HEADING, 1)).cast("long").alias("level"), F.col("line").alias("line_start"), F.col("page").alias("page_start"))
    none = lines.where("line = 1").join(h.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("").alias("title"), F.lit(0).cast("long").alias("level"), F.col("line").alias("line_start"), F.col("page").alias("page_start"))
    after = F.lead("line_start").over(Window.partitionBy("doc_id").orderBy("line_start"))
    return h.unionByName(none).withColumn("next", after).join(last, "doc_id").select("doc_id", "title", "level", "line_start", F.coalesce(F.col("next") - 1, F.col("n")).alias("line_end"), "page_start")


def numbers(lines: DataFrame, most: int = 20) -> DataFrame:
    """(doc_id, nth, line, value): the first numbers of each document, lines that mark pages left out."""
    t = lines.where(~F.col("text").rlike(PAGE_COMMENT) & ~F.col("text").rlike(PAGE_TEXT))
    v = t.select("doc_id", "line", F.posexplode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("i", "value"))
    return v.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "i")).cast("long")).where(F.col("nth") <= most).select("doc_id", "nth", "line", F.trim("value").alias("value"))


def marker_warnings(docs: DataFrame) -> DataFrame:
    """(doc_id, markers, density, sparse, dense, consecutive, empty_sections) of documents with a line that is not blank."""
    rows = docs.select("doc_id", F.posexplode(md.lines(F.col("text"))).alias("i", "t")).where("trim(t) <> ''")
    mark = F.col("t").rlike(r"(?i)^\s*<!--\s*chunk\s*-->\s*$")
    nxt = Window.partitionBy("doc_id").orderBy("i")
    r = rows.select("doc_id", "i", mark.alias("m")).withColumn("next", F.lead("m").over(nxt))
    both = F.count_if(F.col("m") & F.coalesce("next", F.lit(False)))
    c = r.groupBy("doc_id").agg(F.count_if("m").alias("markers"), F.count("*").alias("n"), both.alias("consecutive"), F.count_if(F.col("m") & F.coalesce("next", F.lit(True))).alias("empty_sections"))
    density = F.round(F.col("markers") / F.col("n"), 4)
    return c.select("doc_id", "markers", density.alias("density"), ((F.col("markers") == 0) & (F.col("n") >= 12)).alias("sparse"), (density > 0.3).alias("dense"), "consecutive", "empty_sections")


def evidence_candidates(sources: DataFrame, least: int = 20, most: int = 400) -> DataFrame:
    """(source, pos, span, topic): spans of (pos, source, text) that can be asked about, each once a source, the first of those that differ in case only."""
    s = sources.select("pos", "source", F.posexplode(rc.evidence_lines(F.coalesce("text", F.lit("")), most)).alias("i", "span")).where(F.length("span") >= least)
    first = F.min_by("span", F.struct("pos", "i"))
    return s.groupBy("source", F.lower("span").alias("k")).agg(first.alias("span"), F.min("pos").alias("pos")).select("source", "pos", "span", rc.span_topic(F.col("span")).alias("topic"))


def freeze(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, part, rows, sha256): a digest of each table that no order of rows or partitions changes, from sums of row hashes."""
    out = None
    for part, df in tables.items():
        row = F.xxhash64(*(F.col(c) for c in sorted(df.columns))).cast("decimal(38,0)")
        d = df.select(row.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).alias("s"))
        d = d.select(F.lit(name).alias("name"), F.lit(part).alias("part"), "rows", F.sha2(F.concat_ws("|", F.lit(part), "rows", F.col("s").cast("string")), 256).alias("sha256"))
        out = d if out is None else out.unionByName(d)
    return out


def verify(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(part, same) of two freezes."""
    return frozen.select("part", F.col("sha256").alias("a")).join(now.select("part", F.col("sha256").alias("b")), "part", "full").select("part", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def compare_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row over two runs of hits (query_id, rank, doc_id): queries whose first hit stays, average hits, queries that lost or gained all hits."""
    side = lambda d, s: d.groupBy("query_id").agg(F.count("*").alias(f"n{s}"), F.min_by("doc_id", "rank").alias(f"t{s}"))
    j = side(baseline, 0).join(side(candidate, 1), "query_id", "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    return j.agg(F.count("*").alias("queries"), F.count_if(F.col("t0") == F.col("t1")).alias("same_first"), F.round(F.count_if(F.col("t0") == F.col("t1")) / F.count("*"), 4).alias("top1_stability"),
                 F.round(F.avg(n("n1") - n("n0")), 4).alias("mean_hit_delta"), F.count_if(n("n1") == 0).alias("lost"), F.count_if(n("n0") == 0).alias("gained"))


def tie_break(candidates: DataFrame) -> DataFrame:
    """Place of each candidate (query_id, name, score, cosine): score, then name; of equal positive scores with two cosines or more, those with a cosine first, the nearest first."""
    group = Window.partitionBy("query_id", "score")
    by = (F.col("score") > 0) & (F.count("cosine").over(group) >= 2)
    c = candidates.withColumn("by_centroid", by)
    near = F.when(F.col("by_centroid"), F.col("cosine"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last(near), "name")
    return c.withColumn("place", F.row_number().over(order).cast("long"))


def merge_layers(layers: DataFrame, order: list[str]) -> DataFrame:
    """(path, key, value, layer, conflict): the last layer's value of each key of (layer, path, key, value), and whether layers differ."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("layer"))
    return layers.withColumn("r", rank).groupBy("path", "key").agg(F.max_by("value", "r").alias("value"), F.max_by("layer", "r").alias("layer"), (F.count_distinct("value") > 1).alias("conflict"))


def name_collisions(names: DataFrame, wanted: str) -> DataFrame:
    """(name, kind) of names that are the wanted one, or it with a number in brackets."""
    numbered = F.col("name").startswith(wanted + "(") & F.substring("name", len(wanted) + 1, 1 << 20).rlike(r"^\(\d+\)$")
    return names.select("name", F.when(F.col("name") == wanted, "exact").when(numbered, "suffix").alias("kind")).where("kind IS NOT NULL")


def strength(cases: DataFrame) -> DataFrame:
    """One row: how much a benchmark (query_id, query_type, n_chunks, n_terms, n_qa, negative, documents) covers, and a score of 0 to 1."""
    n = F.count("*")
    share = lambda c: F.count_if(c) / n
    a = cases.agg(n.alias("queries"), share(F.col("n_chunks") > 0).alias("chunks"), share(F.col("n_terms") > 0).alias("terms"), share(F.col("negative")).alias("negative"), F.count_distinct("query_type").alias("types"),
                  F.count_if(F.col("n_qa") > 0).alias("qa"), F.size(F.array_distinct(F.flatten(F.collect_set("documents")))).alias("documents"))
    score = F.col("chunks") * 0.40 + F.col("terms") * 0.20 + F.least(F.col("documents"), F.lit(3)) / 3 * 0.15 + F.least(F.col("types"), F.lit(4)) / 4 * 0.10 + F.least(F.col("qa"), F.col("queries")) / F.col("queries") * 0.10 + F.col("negative") * 0.05
    return a.select("queries", F.round("chunks", 4).alias("chunk_coverage"), F.round("terms", 4).alias("term_coverage"), "types", F.col("documents").cast("long").alias("documents"), F.when(F.col("queries") > 0, F.round(score, 4)).otherwise(0.0).alias("score"))


def throughput(items: Column, ms: Column) -> Column:
    """struct(items_per_second, ms_per_item); nulls without items or time."""
    ok = (items > 0) & (ms > 0)
    return F.struct(F.when(ok, F.round(items / (ms / 1000), 3)).alias("items_per_second"), F.when(ok, F.round(ms / items, 3)).alias("ms_per_item"))
