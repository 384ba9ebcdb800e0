"""Variants of a question, its complexity and its parts, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions import labels as lb
from sievelake.functions import text as tx

# Patterns and terms that results depend on.
OPENINGS = [
    (r"^how do i\s+", "how to "),
    (r"^how can i\s+", "how to "),
    (r"^what is the\s+", ""),
    (r"^what is\s+", ""),
    (r"^where is the\s+", ""),
    (r"^where can i find\s+", ""),
]
TERMS = {
    "api": "接口", "apis": "接口", "authentication": "认证", "auth": "认证", "chunk": "分块", "chunks": "分块", "citation": "引用", "citations": "引用",
    "config": "配置", "configuration": "配置", "dataset": "数据集", "datasets": "数据集", "document": "文档", "documents": "文档", "evidence": "证据",
    "index": "索引", "metadata": "元数据", "profile": "配置档", "query": "查询", "rerank": "重排", "retrieval": "检索", "rewrite": "改写", "route": "路由",
    "routing": "路由", "runtime": "运行时", "source": "来源", "sources": "来源", "trace": "追踪", "validation": "验证",
}
NAMES = {"勒迈特": ["Lemaître", "Lemaitre"]}
COORDINATION = [r"\band\b", r"\bthen\b", r"\balso\b", r"\bcompare\b", r"\bversus\b", r"\bvs\.?\b", r"\btrade-?offs?\b", r"\bsteps?\b", r"\barchitecture\b"]
PARTS = r"(?i)\b(?:and|then|also|versus|vs)\b|[;；]"
VERBS = r"(?i)^(compare|explain|describe|summarize|analyze)\s+"
MODES = ("none", "simple", "translate", "crosslingual")


def _none() -> Column:
    return F.array().cast("array<string>")


def first_of_equals(items: Column) -> Column:
    """Each text once, the first of those that differ in case only, in order."""
    low = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def simple_variants(question: Column) -> Column:
    """The question without end marks, with its opening shortened, and as bare tokens if it has 2 to 8."""
    flat = tx.collapse(question)
    bare = F.trim(F.regexp_replace(flat, "[?.!。！？]+$", ""))
    low = F.lower(bare)
    out = [F.when((bare != "") & (bare != flat), bare)]
    for pattern, new in OPENINGS:
        short = F.trim(F.regexp_replace(low, pattern, new))
        out.append(F.when((short != "") & (short != low), short))
    tokens = F.regexp_extract_all(bare, F.lit(tx.TOKEN), F.lit(0))
    out.append(F.when(F.size(tokens).between(2, 8), F.array_join(tokens, " ")))
    return F.array_compact(F.array(*out))


def translated_variants(question: Column) -> Column:
    """The question followed by the known translations of its tokens, if there are any."""
    tokens = F.regexp_extract_all(F.lower(question), F.lit(r"[0-9A-Za-z_]+|[\x{4E00}-\x{9FFF}]+"), F.lit(0))
    known = lb.literal_map(TERMS)
    terms = F.array_distinct(F.array_compact(F.transform(tokens, lambda t: F.element_at(known, t))))
    return F.when(F.size(terms) > 0, F.array(F.concat(question, F.lit(" "), F.array_join(terms, " ")))).otherwise(_none())


def name_variants(question: Column) -> Column:
    """The question with known names in their original spelling."""
    flat = tx.collapse(question)
    out = [F.when(F.contains(flat, F.lit(name)), F.replace(flat, F.lit(name), F.lit(other))) for name, others in NAMES.items() for other in others]
    return first_of_equals(F.array_compact(F.array(*out)))


def rewrite_plan(question: Column, mode: str, given: Column | None = None) -> Column:
    """The question and its variants of a mode, then ``given`` ones, each once."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    flat = tx.collapse(question)
    variants = {"none": _none(), "simple": simple_variants(flat), "translate": translated_variants(flat), "crosslingual": name_variants(flat)}[mode]
    more = F.transform(given, tx.collapse) if given is not None else _none()
    return first_of_equals(F.concat(F.array(flat), variants, more))


def markers(question: Column) -> Column:
    """How many of the coordination patterns a question has."""
    low, total = F.lower(question), F.lit(0)
    for pattern in COORDINATION:
        total = total + low.rlike(pattern).cast("int")
    return total


def complexity(question: Column, intent: Column) -> Column:
    """simple, moderate or complex, by length, coordination and question marks."""
    n, marks = F.size(tx.token_list(question)), F.regexp_count(question, F.lit("[?？]"))
    closed = intent.isin("clarification_needed", "out_of_scope")
    return (
        F.when(closed, "simple").when((n > 28) | (markers(question) >= 3) | (marks > 1), "complex")
        .when((intent == "comparison") | (n > 12) | (markers(question) > 0), "moderate").otherwise("simple")
    )


def clause(text: Column) -> Column:
    """A part of a question as one of its own: without its opening verb and outer marks, its first letter large."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), VERBS, ""), r"^[ ,.;:!?]+|[ ,.;:!?]+$", "")
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 20))


def subqueries(question: Column, intent: Column, most: int = 4) -> Column:
    """The parts of a question that is not simple, of two tokens or more, each once, ``most`` at most."""
    split = F.transform(F.split(F.regexp_replace(question, PARTS, "\u0001"), "\u0001"), clause)
    parts = F.filter(split, lambda x: F.size(tx.token_list(x)) >= 2)
    bare, low = F.regexp_replace(question, "[?.!]+$", ""), F.lower(question)
    both = lambda a, b: F.array(F.concat(bare, F.lit(a)), F.concat(bare, F.lit(b)))
    parts = F.concat(parts, F.when((intent == "comparison") & (F.size(parts) < 2), both(" key criteria", " differences")).otherwise(_none()))
    pros = F.contains(low, F.lit("pros and cons")) & ~F.exists(parts, lambda x: F.contains(F.lower(x), F.lit("pros")))
    parts = F.concat(parts, F.when(pros, both(" advantages", " disadvantages")).otherwise(_none()))
    closed = (complexity(question, intent) == "simple") | intent.isin("clarification_needed", "out_of_scope")
    return F.when(closed, _none()).otherwise(F.slice(first_of_equals(F.transform(parts, tx.collapse)), 1, most))
