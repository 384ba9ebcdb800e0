"""Scalar rules on records: redaction, addresses, durations, digests, estimates, configurations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions import cleaning as cl
from sievelake.functions import text as tx

# Patterns, replacements and bounds that results depend on.
REDACTIONS = [
    ("bearer_token", r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{6,}", "Bearer <redacted:bearer-token>"),
    ("query_secret", r"(?i)([?&](?:api[_-]?key|token|access_token|secret|password)=)([^&#\s]+)", "$1<redacted:query-secret>"),
    ("assignment_secret", r"(?i)\b(api[_-]?key|token|secret|password|authorization)\s*([:=])\s*([^\s,;\"']+)", "$1$2<redacted:secret>"),
]
LOCAL_HOSTS = ["localhost"]
TARGET_TOKENS, FLOOR_TOKENS, STEP_TOKENS = 4096, 1024, 512
UNITS = {"ms": 1.0, "s": 1000.0, "sec": 1000.0, "m": 60000.0, "min": 60000.0}


def redacted(text: Column, literals: list[str] = ()) -> Column:
    """struct(text, and the number of replacements of each rule): the patterns one after another, then literals, longest first."""
    counts = []
    for name, pattern, new in REDACTIONS:
        counts.append(F.regexp_count(text, F.lit(pattern)).cast("long").alias(name))
        text = F.regexp_replace(text, pattern, new)
    for secret in sorted({x for x in literals if x}, key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(secret), F.lit("<redacted:secret>"))
    return F.struct(text.alias("text"), *counts)


def ip_number(host: Column) -> Column:
    """A dotted IPv4 address as a number; null if it is none."""
    parts = F.transform(F.split(host, r"\."), lambda x: x.cast("long"))
    fits = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda x: x <= 255)
    return F.when(fits, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def host_class(host: Column) -> Column:
    """unknown, local, lan, vpn, private, hostname or public, from a host's name or IPv4 address."""
    flat = F.lower(F.trim(host))
    ip = ip_number(flat)
    within = lambda *nets: [ip.between(a * 16777216 + b * 65536 + c * 256, a * 16777216 + b * 65536 + c * 256 + size - 1) for a, b, c, size in nets]
    any_of = lambda xs: xs[0] if len(xs) == 1 else xs[0] | any_of(xs[1:])
    lan, vpn = any_of(within((10, 0, 0, 1 << 24), (172, 16, 0, 1 << 20), (192, 168, 0, 1 << 16), (169, 254, 0, 1 << 16))), any_of(within((100, 64, 0, 1 << 22)))
    private = any_of(within((0, 0, 0, 1 << 24), (192, 0, 0, 256), (192, 0, 2, 256), (198, 18, 0, 1 << 17), (198, 51, 100, 256), (203, 0, 113, 256), (240, 0, 0, 1 << 28)))
    return (
        F.when(F.coalesce(host, F.lit("")) == "", "unknown").when(flat.isin(LOCAL_HOSTS), "local").when(any_of(within((127, 0, 0, 1 << 24))), "local").when(lan, "lan").when(vpn, "vpn")
        .when(private, "private").when(ip.isNotNull(), "public").when(flat.rlike(r"\.(local|lan)$"), "lan").when(~F.contains(flat, F.lit(".")), "hostname").otherwise("public")
    )


def endpoint(url: Column) -> Column:
    """What an address may tell: scheme, class of its host, port, whether it has a path or a query."""
    part = lambda p: F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(\?[^#]*)?", p)
    return F.struct(
        F.lower(part(1)).alias("scheme"), host_class(part(2)).alias("host_class"), F.when(part(3) != "", part(3).try_cast("int")).alias("port"),
        F.coalesce(~part(4).isin("", "/"), F.lit(False)).alias("has_path"), F.coalesce(part(5) != "", F.lit(False)).alias("has_query"),
    )


def duration_ms(value: Column, unit: Column) -> Column:
    factor = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.round(value * F.coalesce(F.element_at(factor, F.lower(unit)), F.lit(1.0)), 3)


def table_tokens(rows: Column, columns: Column, cells: Column, text: Column) -> Column:
    """struct(estimate, recommended): tokens of a table, and the size a chunk should have to hold it, in steps of 512 from 1,024 to 4,096."""
    estimate = F.greatest(tx.token_estimate(text), cells * 4, rows * F.greatest(columns, F.lit(1)) * 3).cast("long")
    steps = F.floor((estimate + STEP_TOKENS - 1) / STEP_TOKENS) * STEP_TOKENS
    return F.struct(estimate.alias("estimate"), F.least(F.lit(TARGET_TOKENS), F.greatest(F.lit(FLOOR_TOKENS), steps)).cast("long").alias("recommended"))


def comparable(text: Column) -> Column:
    """A Markdown text as it is compared: without markers and empty lines, image targets masked, blanks collapsed."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?im)^[ \t]*<!--[ \t]*chunk[ \t]*-->[ \t]*$", "\n")
    flat = F.regexp_replace(flat, r"!\[([^\]]*)\]\([^)]+\)", "![$1](<image>)")
    return F.array_join(F.filter(F.transform(F.split(flat, "\n"), tx.collapse), lambda x: x != ""), "\n")


def pandoc_total(text: Column) -> Column:
    """Artifacts of a converter in a text, of all four kinds."""
    return sum((cl.change_count(text, r) for r in ("pandoc_div", "pandoc_anchor", "pandoc_tail")), F.lit(0)) + sum((F.regexp_count(text, F.lit(p)) for p, _ in cl.RULES["pandoc_style"]), F.lit(0))


def config_diff(requested: Column, effective: Column) -> Column:
    """struct(missing, extra, changed, drift) of two maps: sorted keys."""
    a, b = F.map_keys(requested), F.map_keys(effective)
    both = F.filter(F.array_intersect(a, b), lambda k: ~F.element_at(requested, k).eqNullSafe(F.element_at(effective, k)))
    missing, extra, changed = (F.array_sort(x) for x in (F.array_except(a, b), F.array_except(b, a), both))
    return F.struct(missing.alias("missing"), extra.alias("extra"), changed.alias("changed"), (F.size(missing) + F.size(extra) + F.size(changed) > 0).alias("drift"))


def embedding_drift(observed: Column, expected: Column) -> Column:
    """not_configured, match or mismatch of a model and those expected, without regard to case."""
    model = F.coalesce(F.nullif(F.trim(observed), F.lit("")), F.lit("unknown"))
    known = (F.coalesce(F.size(expected), F.lit(0)) > 0) & (model != "unknown")
    return F.when(~known, "not_configured").when(F.array_contains(F.transform(expected, F.lower), F.lower(model)), "match").otherwise("mismatch")


def span_topic(span: Column) -> Column:
    """The first five terms of a span, 80 characters at most."""
    terms = F.regexp_extract_all(span, F.lit(r"[A-Za-z][A-Za-z0-9_-]{2,}|[\x{4E00}-\x{9FFF}]{2,}"), F.lit(0))
    return F.when(F.size(terms) > 0, F.substring(F.array_join(F.slice(terms, 1, 5), " "), 1, 80)).otherwise("the cited evidence")


def evidence_lines(text: Column, most: int = 400) -> Column:
    """Lines that can stand as evidence: no code, headings, images, rules or table rules; long ones by sentence, cut at ``most`` characters."""
    fence = r"(?ms:^[ \t]*```[^\n]*(?:\n|\z)(?:.*?^[ \t]*```[^\n]*(?:\n|\z)|.*))"
    free = cl.outside(F.regexp_replace(text, r"\r\n?", "\n"), None, lambda t: F.regexp_replace(t, fence, "\n"))
    rows = F.transform(F.split(free, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = F.filter(rows, lambda x: (x != "") & ~x.rlike(r"^[#!]") & ~x.rlike(r"^[-*_=\s]{3,}$") & ~x.rlike(r"^\|?[\s:|.-]+\|?$"))
    cut = lambda x: F.regexp_replace(F.substring(x, 1, most), r"\s+$", "")
    parts = F.transform(rows, lambda x: F.when(F.length(x) <= most, F.array(x)).otherwise(F.transform(F.filter(F.split(F.regexp_replace(x, r"([.!?。！？])\s+", "$1\u0001"), "\u0001"), lambda p: F.trim(p) != ""), lambda p: cut(F.trim(p)))))
    return F.flatten(parts)


def sorted_digest(values: Column) -> Column:
    """sha256 of a set of texts, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\n"), 256)
