"""Markdown cleaning: rules with the number of changes, each outside of what it must not touch, and profiles of rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions import text as tx

# Patterns and replacements of the cleaning rules, and which rules a profile has, in order.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
RULES: dict[str, list[tuple[str, str]]] = {
    "crlf": [(r"\r\n?", "\n")],
    "trailing": [(r"(?m)[ \t]+$", "")],
    "blank": [(r"\n{3,}", "\n\n")],
    "heading": [(r"(?m)^(#{1,6})([^#\s](?:[^\n]*[^\s])?)[ \t]*$", "$1 $2")],
    "punctuation": [
        (tx.SPACE + r"([,.;:!?，。；：！？、])", "$1"),
        (r"([，。；：！？、])" + tx.SPACE, "$1"),
        (r"([（(\[{])" + tx.SPACE, "$1"),
        (tx.SPACE + r"([）)\]}])", "$1"),
    ],
    "pandoc_div": [(r"(?m)^[ \t]*:{3,}[ \t]*(?:\{[^}\n]*\})?[ \t]*(?:\n|$)", "")],
    "pandoc_anchor": [(r"\[\]\{#[^}\n]+\}", "")],
    "pandoc_style": [
        (r"""\[([^\]\n]+)\]\{[^}\n]*\bstyle\s*=\s*(?:"[^"]*"|'[^']*'|[^\s}]+)[^}\n]*\}""", "$1"),
        (r"""(?i)\s+style\s*=\s*("[^"]*"|'[^']*')""", ""),
    ],
    "pandoc_tail": [(r"(?m)^([ \t]*#{1,6}[ \t]*.*?)[ \t]+\{#[A-Za-z0-9_.:-]+(?:[ \t][^}\n]*)?\}[ \t]*$", "$1")],
    "cjk": [(f"(?<={CJK}){tx.SPACE}(?={CJK})", "")],
    "ligature": [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")],
}
HTML_TABLE = r"(?is:<table\b.*?</table\s*>)"
PIPE_TABLE = r"(?m:^[^\n]*\|[^\n]*\n[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*(?:\n|\z)(?:[^\n]*\|[^\n]*(?:\n|\z))*+)"
TABLE = f"{HTML_TABLE}|{PIPE_TABLE}"
FENCE = r"(?ms:^[ \t]*(?:```|~~~)[^\n]*(?:\n|\z)(?:.*?^[ \t]*(?:```|~~~)[^\n]*(?:\n|\z)|.*))"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
SAFE = ["crlf", "trailing", "blank", "heading", "images", "final_newline"]
PROFILES = {
    "none": [],
    "safe": SAFE,
    "ocr": [*SAFE, "cjk", "punctuation", "ligature"],
    "pandoc-epub": ["crlf", "trailing", "pandoc_div", "pandoc_anchor", "pandoc_style", "pandoc_tail", "blank", "heading", "images", "final_newline"],
}
#: What a rule leaves alone.
PROTECTED = {"heading": FENCE, "cjk": TABLE, "punctuation": TABLE, "ligature": TABLE}

_MARK, _CUT = "\u0001", "\u0001b"


def _may_have(text: Column, pattern: str) -> Column:
    """Whether a text has what every match of the pattern has; most texts have not, and are not cut."""
    if pattern == FENCE:
        return F.contains(text, F.lit("```")) | F.contains(text, F.lit("~~~"))
    return F.contains(text, F.lit("|")) | text.rlike("<[tT]") if pattern == TABLE else F.lit(True)


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at the matches of a pattern: free, match, free, ...; the mark that cuts is escaped in the text."""
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(_MARK + "a")), pattern, f"{_CUT}$0{_CUT}")
    return F.transform(F.split(marked, _CUT, -1), lambda x: F.replace(x, F.lit(_MARK + "a"), F.lit(_MARK)))


def outside(text: Column, pattern: str | None, f: Callable[[Column], Column]) -> Column:
    """``f`` of each part outside the matches of a pattern, the matches as they are."""
    if pattern is None:
        return f(text)

    def cut(t: Column) -> Column:
        parts = F.transform(pieces(t, pattern), lambda x, i: F.when(i % 2 == 1, x).otherwise(f(x)))
        return F.when(_may_have(t, pattern), F.array_join(parts, "")).otherwise(f(t))

    return tx.let(text, cut)


def inside(text: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """``f`` of each match of a pattern, the rest as it is."""

    def cut(t: Column) -> Column:
        parts = F.array_join(F.transform(pieces(t, pattern), lambda x, i: F.when(i % 2 == 1, f(x)).otherwise(x)), "")
        return F.when(F.contains(t, F.lit("![")), parts).otherwise(t) if pattern == IMAGE else parts

    return tx.let(text, cut)


def image_target(image: Column) -> Column:
    """An image's link with a plain local target: slashes forward, no leading ./, absolute paths from images/ on, blanks in angle brackets."""
    head, raw = F.regexp_extract(image, r"^(!\[[^\]]*\]\()", 1), F.regexp_extract(image, r"\(([^)]+)\)$", 1)
    value = F.regexp_replace(raw, r"^\s+|\s+$", "")
    angle = value.startswith("<") & F.contains(value, F.lit(">"))
    target = F.when(angle, F.regexp_extract(value, "^<([^>]*)>", 1)).otherwise(F.regexp_extract(value, r"^(\S*)", 1))
    title = F.regexp_extract(value, r"^\S+\s+(.*)$", 1)
    rest = F.when(angle, F.regexp_extract(value, "(?s)^<[^>]*>(.*)$", 1)).otherwise(F.when(title != "", F.concat(F.lit(" "), title)).otherwise(""))
    plain = F.regexp_replace(F.replace(target, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")
    far = plain.rlike("^(/|~/|[A-Za-z]:/)") & F.contains(plain, F.lit("/images/"))
    plain = F.when(far, F.concat(F.lit("images/"), F.substring_index(plain, "/images/", -1))).otherwise(plain)
    plain = F.when(angle | F.contains(plain, F.lit(" ")), F.concat(F.lit("<"), plain, F.lit(">"))).otherwise(plain)
    remote = F.lower(value).rlike("^(https?://|data:|#)")
    return F.when(remote, image).otherwise(F.concat(head, plain, rest, F.lit(")")))


def _replaced(rule: str) -> Callable[[Column], Column]:
    def f(text: Column) -> Column:
        for pattern, new in RULES[rule]:
            text = F.regexp_replace(text, pattern, new)
        return text

    return f


def clean(text: Column, rule: str) -> Column:
    """``text`` after one rule."""
    if rule == "final_newline":
        return tx.let(text, lambda t: F.when((t == "") | t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n"))))
    if rule == "images":
        return inside(text, IMAGE, image_target)
    return outside(text, PROTECTED.get(rule), _replaced(rule))


def change_count(text: Column, rule: str) -> Column:
    """Matches of the rule's patterns where it applies, each pattern seen after those before it."""
    if rule == "final_newline":
        return F.when((text == "") | text.endswith("\n"), 0).otherwise(1).cast("long")
    if rule == "images":
        changed = F.transform(pieces(text, IMAGE), lambda x, i: ((i % 2 == 1) & (image_target(x) != x)).cast("long"))
        cut = F.aggregate(changed, F.lit(0).cast("long"), lambda s, x: s + x)
        return F.when(F.contains(text, F.lit("![")), cut).otherwise(F.lit(0).cast("long"))

    def matches(part: Column) -> Column:
        total = F.lit(0)
        for pattern, new in RULES[rule]:
            total = total + F.regexp_count(part, F.lit(pattern))
            part = F.regexp_replace(part, pattern, new)
        return total.cast("long")

    if rule not in PROTECTED:
        return matches(text)

    def cut(t: Column) -> Column:
        found = F.transform(pieces(t, PROTECTED[rule]), lambda x, i: F.when(i % 2 == 1, F.lit(0).cast("long")).otherwise(matches(x)))
        return F.when(_may_have(t, PROTECTED[rule]), F.aggregate(found, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(matches(t))

    return tx.let(text, cut)


def clean_all(text: Column, rules: list[str]) -> Column:
    """The rules one after another."""
    for rule in rules:
        text = clean(text, rule)
    return text


def clean_profile(text: Column, profile: str) -> Column:
    """All rules of a profile, one after another."""
    return clean_all(text, PROFILES[profile])
