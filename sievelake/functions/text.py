"""Text functions as Catalyst expressions; a null text gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and character classes that results depend on.
EVIDENCE_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "use", "what", "when",
    "where", "which", "with", "without",
]
POLLUTION_STOPWORDS = EVIDENCE_STOPWORDS + [
    "answer", "chunk", "chunks", "content", "document", "documents", "evidence", "query", "question", "result", "results", "retrieval", "source", "sources",
]
TOPOLOGY_STOPWORDS = ["about", "after", "and", "are", "body", "can", "for", "from", "how", "into", "the", "this", "under", "what", "when", "where", "which", "with"]
AMBIGUOUS_TERMS = ["api", "config", "guide", "key", "manual", "model", "policy", "profile", "runtime", "service", "setup", "token"]
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TOKEN = r"[0-9A-Za-z_\x{4E00}-\x{9FFF}]+"
TERM = r"[A-Za-z][A-Za-z0-9_-]{2,}|[\x{4E00}-\x{9FFF}]{2,12}"
CJK = r"[\x{4E00}-\x{9FFF}]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    """Every run of Unicode white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def stable_hash(text: Column) -> Column:
    """sha256 of the collapsed text; texts that differ in white space only share it."""
    return F.sha2(F.encode(collapse(text), "UTF-8"), 256)


def token_list(text: Column) -> Column:
    """Lower-case tokens in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _minus(tokens: Column, words: list[str]) -> Column:
    return F.array_except(tokens, F.array(*map(F.lit, words)))


def evidence_tokens(text: Column) -> Column:
    """Distinct tokens without stop words."""
    return _minus(token_list(text), EVIDENCE_STOPWORDS)


def pollution_tokens(text: Column) -> Column:
    """Distinct tokens without stop words and words of the retrieval domain."""
    return _minus(token_list(text), POLLUTION_STOPWORDS)


def route_tokens(text: Column) -> Column:
    """Distinct tokens, stop words kept."""
    return F.array_distinct(token_list(text))


def topology_terms(text: Column) -> Column:
    """Distinct lower-case words of three or more characters, or CJK runs of 2 to 12."""
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    return _minus(F.transform(found, F.lower), TOPOLOGY_STOPWORDS)


def preview(text: Column, limit: int = 220) -> Column:
    """Collapsed text, cut to ``limit`` characters with three dots at the end."""
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK)).cast("long")


def token_estimate(text: Column) -> Column:
    """ceil(length / 2) where an eighth or more is CJK, else ceil(length / 4); 0 if empty."""
    flat = collapse(text)
    size = F.length(flat)
    per = F.when(cjk_count(flat) >= F.greatest(F.lit(1), F.floor(size / 8)), 2).otherwise(4)
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(size / per))).cast("long")


def slug(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 joined by hyphens; 'unknown' if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name)


def control_chars(text: Column) -> Column:
    """C0 control characters except tab, line feed and carriage return."""
    return F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")).cast("long")


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences of ``least`` or more characters, split after end punctuation and white space."""
    parts = F.split(F.regexp_replace(text, r"([。！？.!?]+)\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, collapse), lambda s: F.length(s) >= least)


def jaccard(a: Column, b: Column) -> Column:
    """|A and B| / |A or B| of two arrays, rounded to 4; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.round(F.size(F.array_intersect(a, b)) / union, 4)).otherwise(0.0)


def chunk_reference(ref: Column) -> Column:
    """Both spellings of a chunk reference, with and without the hash prefix."""
    bare = F.regexp_replace(F.trim(ref), "^sha256:", "")
    return F.array(bare, F.concat(F.lit("sha256:"), bare))


def near_duplicate_key(ident: Column, text: Column, document: Column) -> Column:
    """``id:`` and the id; else the first 24 sorted tokens if six or more; else document and preview."""
    tokens = F.sort_array(pollution_tokens(text))
    return (
        F.when(ident.isNotNull() & (ident != ""), F.concat(F.lit("id:"), ident))
        .when(F.size(tokens) >= 6, F.concat(F.lit("tokens:"), F.array_join(F.slice(tokens, 1, 24), " ")))
        .otherwise(F.concat(F.lit("text:"), F.coalesce(document, F.lit("")), F.lit(":"), preview(text, 140)))
    )


def round_half(x: Column, digits: int) -> Column:
    """Halves go up, also those that float noise leaves 1e-9 of a unit short: the same in any engine."""
    return F.floor(x * 10**digits + 0.5 + 1e-9) / 10**digits
