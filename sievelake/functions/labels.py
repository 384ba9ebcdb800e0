"""Labels of queries, hits, documents and addresses, as Catalyst expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions import text as tx

# Names that results depend on.
CATEGORY_NAMES = {
    "text_fact": ["fact", "text", "textual", "text_fact"],
    "table_value": ["table", "table_value", "table_row", "numeric_row"],
    "visual_identification": ["visual", "image", "visual_identification"],
    "diagram_software_screenshot": ["diagram", "screenshot", "software_screenshot", "diagram_software_screenshot"],
    "caption_context": ["caption", "context", "caption_context"],
    "mixed_table_plus_image": ["mixed", "mixed_modality", "mixed_table_image", "mixed_table_plus_image"],
}
CATEGORY_MODALITIES = {
    "text_fact": ["text"],
    "table_value": ["table"],
    "visual_identification": ["image"],
    "diagram_software_screenshot": ["image"],
    "caption_context": ["text"],
    "mixed_table_plus_image": ["image", "mixed", "table"],
}
IMAGE_WORDS = "image|visual|figure|diagram|screenshot"
TEXT_NAMES = ["text", "markdown", "md", "txt", "document"]
IMAGE_SUFFIX = r"\.(png|jpg|jpeg|gif|webp|bmp|tif|tiff)$"
TEXT_SUFFIX = r"\.(md|markdown|txt)$"
ABSTENTIONS = [
    "cannot answer", "can't answer", "not enough information", "insufficient information", "no retrieved evidence", "no evidence",
    "i don't know", "unable to determine", "无法回答", "不能回答", "没有足够", "未检索到", "不知道",
]
SECRETS = [
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\bAKIA[0-9A-Z]{12,}\b",
    r"\bLTAI[A-Za-z0-9]{12,}\b",
    r"\beyJ[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"(?i)(api[_-]?key|token|secret|authorization)\s*[:=]\s*\S+",
]


def literal_map(pairs: dict) -> Column:
    """A map of literals; a list becomes an array."""
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.create_map(*chain.from_iterable((F.lit(k), lit(v)) for k, v in pairs.items()))


def snake(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def test_category(text: Column) -> Column:
    """The snake name of a test's category; 'uncategorized' without any."""
    name = snake(text)
    return F.when(F.coalesce(name, F.lit("")) == "", "uncategorized").otherwise(name)


def category(text: Column) -> Column:
    """One of six categories of a query, from its aliases; else null."""
    return F.element_at(literal_map({alias: name for name, aliases in CATEGORY_NAMES.items() for alias in aliases}), F.coalesce(snake(text), F.lit("")))


def category_modalities(name: Column) -> Column:
    """Modalities that a category implies, sorted; none for others."""
    return F.coalesce(F.element_at(literal_map(CATEGORY_MODALITIES), F.coalesce(name, F.lit(""))), F.array().cast("array<string>"))


def modality(text: Column) -> Column:
    """mixed, image, table or text, by the first that a label or media type speaks of; else null."""
    flat, name = F.lower(F.trim(text)), snake(text)
    return (
        F.when(name.rlike("mixed|multimodal"), "mixed").when(flat.startswith("image/") | name.rlike(IMAGE_WORDS), "image")
        .when(name.contains("table"), "table").when(flat.startswith("text/") | name.isin(TEXT_NAMES), "text")
    )


def expected_modalities(label: Column) -> Column:
    """The modalities that a label asks for, sorted; mixed asks for table and image too."""
    one = modality(label)
    return F.when(one == "mixed", F.array(F.lit("image"), F.lit("mixed"), F.lit("table"))).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def hit_modality(label: Column, name: Column, content: Column) -> Column:
    """A hit's modality: by its own label, then by its document's name, then by what it holds; else 'unknown'."""
    file = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(
        modality(label),
        F.when(file.rlike(IMAGE_SUFFIX), "image").when(F.lower(F.coalesce(content, F.lit(""))).contains("<table"), "table").when(file.rlike(TEXT_SUFFIX), "text"),
        F.lit("unknown"),
    )


def query_type(kind: Column, other: Column) -> Column:
    """The first given name of a query's type; else 'default'."""
    given = F.coalesce(F.when(kind != "", kind), other)
    return F.when(F.coalesce(F.trim(given), F.lit("")) != "", given).otherwise("default")


def target_matches(candidate: Column, target: Column) -> Column:
    """Whether a target is a name or a part of it, without regard to case and outer blanks; empty ones match nothing."""
    a, b = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (candidate, target))
    return (a != "") & (b != "") & F.contains(a, b)


def references(ref: Column) -> Column:
    """The spellings of a chunk's reference: a sha256 digest with and without its prefix, others as they are; none of an empty one."""
    flat = F.lower(F.trim(F.coalesce(ref, F.lit(""))))
    none = F.array().cast("array<string>")
    return (
        F.when(flat == "", none).when(flat.startswith("sha256:"), F.array(flat, F.substring(flat, 8, 1 << 20)))
        .when(flat.rlike("^[0-9a-f]{64}$"), F.array(flat, F.concat(F.lit("sha256:"), flat))).otherwise(F.array(flat))
    )


def chunk_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), tx.stable_hash(F.coalesce(content, F.lit(""))))


def abstained(answer: Column) -> Column:
    """Whether an answer says that it can give none."""
    flat, any_of = F.lower(F.trim(F.coalesce(answer, F.lit("")))), F.lit(False)
    for phrase in ABSTENTIONS:
        any_of = any_of | F.contains(flat, F.lit(phrase))
    return any_of


def holds_secret(text: Column) -> Column:
    any_of = F.lit(False)
    for pattern in SECRETS:
        any_of = any_of | F.coalesce(text, F.lit("")).rlike(pattern)
    return any_of


def text_language(text: Column) -> Column:
    """zh where CJK characters are 8 or more and at least half as many as Latin letters, en where there are Latin letters, else unknown."""
    cjk, latin = tx.cjk_count(text), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(cjk >= F.greatest(F.lit(8), F.floor(latin / 2)), "zh").when(latin > 0, "en").otherwise("unknown")


def file_language(name: Column) -> Column:
    """The language that a file's name speaks of; else null."""
    flat = F.lower(name)
    return (
        F.when(flat.rlike("(^|[^a-z0-9])(cn|zh|zho|chinese|ch)([^a-z0-9]|$)") | F.contains(flat, F.lit("中文")), "zh")
        .when(flat.rlike("(^|[^a-z0-9])(en|eng|english)([^a-z0-9]|$)"), "en")
    )


def word_risk(hint: Column) -> Column:
    """Why an English hint may match inside other words: product_term, acronym or short_english_name; else null."""
    flat = F.trim(hint)
    letters, tokens = F.length(F.regexp_replace(flat, "[^A-Za-z]+", "")), F.size(tx.route_tokens(flat))
    english = flat.rlike("[A-Za-z]") & ~flat.rlike(tx.CJK)
    product = flat.rlike("[A-Za-z][0-9]|[0-9][A-Za-z]|[+.#/:_-]") | flat.rlike("[a-z][A-Z]")
    kind = F.when(product, "product_term").when((letters > 0) & (tokens == 1) & (letters <= 5), "acronym").when((F.length(flat) <= 8) & (tokens <= 2), "short_english_name")
    return F.when(english, kind)


def markdown_title(text: Column) -> Column:
    """The first line that is not blank: a heading without its marks (null if nothing is left), another up to 120 characters."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    heading = F.trim(F.regexp_replace(first, "^#+", ""))
    return F.when(first.startswith("#"), F.when(heading != "", heading)).otherwise(F.substring(first, 1, 120))
