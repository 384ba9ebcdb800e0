"""URL filters: rules by host and path, and for the rest trust propagated over the host graph.

Hosts with pages that a rule allows are trusted seeds, hosts with blocked pages distrusted
ones, each in proportion to such pages. Trust is a personalised PageRank along the links,
distrust one against them (a page that links to bad ones is suspect); both go round in one
join. Each is taken as a share of what the host would get if all pages were allowed, or blocked.
A host is blocked where its distrust exceeds its trust, and ``threshold`` times its distrust
exceeds 1 (at 2: it has more than half of the distrust of a wholly blocked web). Edges are
absolute links in the HTML, and a host's tie to its parent domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the query's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path; both empty without '://'."""
    form = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, form, 1), _UPPER, _LOWER), F.regexp_extract(url, form, 2)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    out = None
    for verdict, of, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(of + prefix).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def host_edges(hosts: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts with their number's logarithm, and ties to parent domains both ways."""
    linked = links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.log2(F.count("*") + 1.0).alias("w"))
    parent = F.regexp_extract("host", r"\A[^.]+\.([^.]+\..+)\z", 1)
    ties = hosts.select(F.col("host").alias("src"), parent.alias("dst")).where("dst <> ''").distinct().withColumn("w", F.lit(1.0))
    return linked.unionByName(ties).unionByName(ties.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, at_once: int = 5) -> DataFrame:
    """(host, trust, distrust), shares of 0 to 1, from (host, n, t, d) seeds: pages, and how many of them are trusted and distrusted.

    What all n pages would send is propagated beside t and d; the share is what a host has of the
    rank it would get if every page were trusted, or distrusted. So it depends neither on how many
    pages are ruled elsewhere nor on how much rank the host's edges keep or pass on.

    Every few rounds the ranks are written to the shared folder and compared with the last ones,
    until no share changes by ``tolerance``: the ranks converge as the powers of ``damping`` do.
    Sums are combined before their shuffle, so a host that a third of all links go to is no hot key.
    """

    def shares(a: str, b: str, kind: str) -> DataFrame:
        total = edges.groupBy(a).agg(F.sum("w").alias("all"))
        return edges.join(total, a).select(F.col(a).alias("host"), F.col(b).alias("to"), (F.col("w") / F.col("all")).alias("share"), F.lit(kind).alias("kind"))

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.when(F.col(whole) > 0, F.col(part) / F.col(whole)), F.lit(0.0))

    steps = materialize(shares("src", "dst", "t").unionByName(shares("dst", "src", "d")), "host-steps")
    #: Ranks of the trusted and of all pages along the links, of the distrusted and of all against them.
    kinds = {"trust": ("t", "t"), "all_t": ("n", "t"), "distrust": ("d", "d"), "all_d": ("n", "d")}
    first = seeds.select("host", *(F.col(x).cast("double").alias(c) for c, (x, _) in kinds.items()))
    ranks = first
    settled = steps.isEmpty()
    while not settled:
        before = ranks
        for _ in range(at_once):
            sent = ranks.join(steps, "host").select(F.col("to").alias("host"), *(F.when(F.col("kind") == k, damping * F.col("share") * F.col(c)).otherwise(0.0).alias(c) for c, (_, k) in kinds.items()))
            given = first.select("host", *(((1 - damping) * F.col(c)).alias(c) for c in kinds))
            ranks = given.unionByName(sent).groupBy("host").agg(*(F.sum(c).alias(c) for c in kinds))
        ranks = materialize(ranks, "host-ranks")
        last = before.select("host", share("trust", "all_t").alias("t0"), share("distrust", "all_d").alias("d0"))
        gap = ranks.join(last, "host", "left").agg(F.max(F.greatest(F.abs(share("trust", "all_t") - F.coalesce("t0", F.lit(0.0))), F.abs(share("distrust", "all_d") - F.coalesce("d0", F.lit(0.0)))))).first()[0]
        settled = (gap or 0.0) < tolerance
    return ranks.select("host", share("trust", "all_t").alias("trust"), share("distrust", "all_d").alias("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = 2.0) -> DataFrame:
    """Verdict of every page of (page_id, url, html).

    Defined cases: a null url, or one without '://', has an empty host and path, fits no rule and
    is allowed; null html has no links; hosts without any seed near are allowed; each row gives a
    row; an empty table gives no rows.

    Returns page_id, host, path, rule, verdict.
    """
    host, path = split_url(F.col("url"))
    links = F.when(F.col("html").contains("//"), F.regexp_extract_all("html", F.lit(_LINK), 1)).otherwise(F.array().cast("array<string>"))
    judged = materialize(pages.select("page_id", host.alias("host"), path.alias("path"), F.transform(links, lambda x: F.translate(x, _UPPER, _LOWER)).alias("links")).withColumn("by_rule", best_rule(F.col("host"), F.col("path"), rules)), "pages")
    verdict = F.col("by_rule.verdict")
    hosts = materialize(judged.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(verdict == "allow").alias("allowed"), F.count_if(verdict == "block").alias("blocked")), "hosts")
    seeds = hosts.where("host <> ''").select("host", F.col("pages").alias("n"), F.col("allowed").alias("t"), F.col("blocked").alias("d"))
    edges = host_edges(hosts.where("host <> ''"), judged.select(F.col("host").alias("src"), F.explode("links").alias("dst")))
    ranks = propagate(seeds, materialize(edges, "host-edges"))
    bad = ranks.where((F.col("distrust") > F.col("trust")) & (threshold * F.col("distrust") > 1.0)).select("host", F.lit(True).alias("bad"))
    out = judged.join(bad, "host", "left")
    return out.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
