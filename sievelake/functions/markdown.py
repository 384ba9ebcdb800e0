"""Structure of Markdown texts as Catalyst expressions: lines, tables, markers, formulas, segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions import cleaning as cl
from sievelake.functions import text as tx

# Patterns of the structure.
SEPARATOR = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"
MARKER = r"(?im)^[ \t]*<!--[ \t]*chunk[ \t]*-->[ \t]*$"
BOUNDARY = r"(?i)^\s*(?:#{1,6}\s+.+|<!--\s*chunk\s*-->)\s*$"


def lines(text: Column) -> Column:
    """The lines of a text, without the empty one after its last line feed."""
    return F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\z", ""), "\n", -1)


def pipe_tables(text: Column) -> Column:
    """How many lines with a bar stand before a separator line."""

    def heads(rows: Column) -> Column:
        return F.size(F.filter(rows, lambda x, i: F.contains(x, F.lit("|")) & F.coalesce(F.get(rows, i + 1).rlike(SEPARATOR), F.lit(False))))

    return tx.let(lines(text), heads).cast("long")


def html_table_hashes(text: Column) -> Column:
    """sha256 of every HTML table, line ends made equal, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(cl.HTML_TABLE), F.lit(0)), lambda t: F.sha2(F.regexp_replace(t, r"\r\n?", "\n"), 256))


def tables_balanced(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?i)<table\b")) == F.regexp_count(text, F.lit(r"(?i)</table\s*>"))


def markers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(MARKER)).cast("long")


def markers_in_tables(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(cl.HTML_TABLE), F.lit(0))
    return F.aggregate(F.transform(found, markers), F.lit(0).cast("long"), lambda s, x: s + x)


def unbalanced_fragments(text: Column) -> Column:
    """Fragments between markers with more table openings than ends, or fewer."""
    return F.size(F.filter(F.split(F.regexp_replace(text, MARKER, "\u0001"), "\u0001", -1), lambda x: ~tables_balanced(x))).cast("long")


def math_unbalanced(text: Column) -> Column:
    """Whether dollar signs that are not escaped are odd in number, or brackets of formulas unequal."""
    n = lambda s: F.regexp_count(text, F.lit(s))
    return (n(r"(?<!\\)\$") % 2 == 1) | (n(r"\\\(") != n(r"\\\)")) | (n(r"\\\[") != n(r"\\\]"))


def segment_starts(text: Column, soft: int = 24_000, hard: int = 32_000, least: int = 4_000) -> Column:
    """First line (from 0) of each segment.

    Once a segment has ``soft`` characters it ends before the last heading or marker that came
    after ``least`` of them; at ``hard`` it ends there too, or after the line. Characters are
    counted with line feeds from the segment's start, as differences of running sums.
    """
    zero = F.lit(0).cast("long")
    state = F.struct(zero.alias("i"), zero.alias("sum"), zero.alias("start"), zero.alias("at_start"), F.lit(-1).cast("long").alias("cut"), zero.alias("at_cut"), F.array(zero).alias("out"))
    end = F.when(text.endswith("\n"), 1).otherwise(0)

    def measured(rows: Column) -> Column:
        return F.transform(rows, lambda x, i: F.struct((F.length(x) + F.when(i + 1 < F.size(rows), 1).otherwise(end)).alias("n"), x.rlike(BOUNDARY).alias("edge")))

    def step(s: Column, line: Column) -> Column:
        here = line["edge"] & (s["i"] > s["start"]) & (s["sum"] - s["at_start"] >= least)
        cut, at_cut = F.when(here, s["i"]).otherwise(s["cut"]), F.when(here, s["sum"]).otherwise(s["at_cut"])
        total = s["sum"] + line["n"]
        size = total - s["at_start"]
        early, late = (size >= soft) & (cut >= 0), (size >= hard) & (cut < 0)
        begin = F.when(early, cut).when(late, s["i"] + 1)
        return F.struct(
            (s["i"] + 1).alias("i"), total.alias("sum"), F.coalesce(begin, s["start"]).alias("start"),
            F.when(early, at_cut).when(late, total).otherwise(s["at_start"]).alias("at_start"),
            F.when(begin.isNull(), cut).otherwise(F.lit(-1).cast("long")).alias("cut"), at_cut.alias("at_cut"),
            F.when(begin.isNull(), s["out"]).otherwise(F.array_append(s["out"], begin)).alias("out"),
        )

    return F.aggregate(tx.let(lines(text), measured), state, step, lambda s: F.filter(s["out"], lambda x: x < F.greatest(s["i"], F.lit(1))))


def segments(text: Column, soft: int = 24_000, hard: int = 32_000, least: int = 4_000) -> Column:
    """(first line, last line, text) of each segment, lines from 1."""

    def cut(both: Column) -> Column:
        rows, starts = both["rows"], both["starts"]

        def one(start: Column, i: Column) -> Column:
            end = F.coalesce(F.get(starts, i + 1), F.size(rows).cast("long"))
            body = F.slice(rows, (start + 1).cast("int"), (end - start).cast("int"))
            return F.struct((start + 1).alias("first_line"), end.alias("last_line"), F.array_join(body, "\n").alias("text"))

        return F.transform(starts, one)

    return tx.let(F.struct(lines(text).alias("rows"), segment_starts(text, soft, hard, least).alias("starts")), cut)
