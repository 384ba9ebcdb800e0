"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is an integer score of a document; a document is rejected where the score reaches
the rule's cutoff in its stratum (its language). Cutoffs are learned from labelled documents:
a cutoff may be used only if the exact binomial bound certifies that it rejects at most a
share ``alpha / rules`` of the good documents of the stratum. Cutoffs of a rule are tested
from lenient to strict and the number of rejected good documents only grows on the way, so
that the sequence needs no further correction; rules and strata share ``delta`` equally
(Bonferroni). Of the certified cutoffs the one that rejects most bad less good labelled
documents is used, the most lenient of equals; one that gains nothing is not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, log_gamma
from .store import materialize

#: Score names; each is a whole percentage, 0 to 100.
RULES = ("symbol_score", "dup_line_score", "repeat_score", "upper_score")
#: Thresholds of more strata than this are joined by a shuffle and not sent to all executors.
_BROADCAST_STRATA = 10_000


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows found twice or more in the text."""
    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(5)))))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(placed, lambda s: F.filter(s, lambda x, i: F.coalesce((i > 0) & (F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
        return F.aggregate(places, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(n >= 5, counted).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts and scores of its texts in one struct column ``_m``; other columns pass unread.

    Characters of n_symbols are counted as what ``translate`` takes away, which needs no pattern.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    counts = F.struct(
        let(words, of_words).alias("w"), let(lines, of_lines).alias("l"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )

    def percent(part: Column, whole: Column) -> Column:
        return F.least(F.lit(100), F.when(whole > 0, F.floor(100 * part / whole)).otherwise(0)).cast("int")

    def scored(c: Column) -> Column:
        w, x = c["w"], c["l"]
        failed = (w["n_words"] < 10) | (100 * w["n_repeat_words"] > 20 * w["n_words"])
        return F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), x["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"),
            percent(c["n_symbols"], w["n_words"]).alias("symbol_score"), percent(x["n_dup_lines"], x["n_lines"]).alias("dup_line_score"), percent(w["n_repeat_words"], w["n_words"]).alias("repeat_score"), percent(c["n_upper"], w["word_chars"]).alias("upper_score"),
        )

    return docs.withColumn("_m", let(counts, scored))


def _most_false(n: Column, alpha: float, delta: Column) -> Column:
    """The largest k with P(Binomial(n, alpha) <= k) <= delta, or -1: the exact binomial bound.

    Terms further than 12 standard deviations below the mean are under 1e-30 together.
    """
    n = n.cast("double")
    start = F.greatest(F.lit(0), F.floor(n * alpha - 12 * F.sqrt(n * alpha * (1 - alpha)) - 40)).cast("long")
    log_first = log_gamma(n + 1) - log_gamma(start + 1) - log_gamma(n - start + 1) + start * F.ln(F.lit(alpha)) + (n - start) * F.ln(F.lit(1 - alpha))
    zero = F.struct(F.exp(log_first).alias("term"), F.lit(0.0).alias("total"), (start - 1).alias("k"))

    def step(a: Column, i: Column) -> Column:
        total = a["total"] + a["term"]
        return F.struct((a["term"] * (n - i) / (i + 1) * (alpha / (1 - alpha))).alias("term"), total.alias("total"), F.when(total <= delta, i).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(start, F.least(n.cast("long"), F.ceil(n * alpha).cast("long"))), zero, step, lambda a: a["k"])


def learn_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff) of every certified and useful cutoff.

    ``measured`` has doc_id, stratum, base_failed and the scores; ``labels`` doc_id and quality
    (1 good, 0 bad). Labels of one doc_id count as good if any is; documents that fail the base
    rules take no part. Counts are combined before their shuffle, a few numbers a stratum.
    """
    judged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    held = measured.where("not base_failed").join(judged, "doc_id")
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in RULES))).alias("x")
    counts = held.select("stratum", "good", rules).groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.score").alias("score")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    tested = counts.withColumn("cutoff", F.explode(F.sequence(F.lit(1), F.lit(100)))).groupBy("stratum", "rule", "cutoff").agg(
        F.sum("good").alias("n"), F.sum(F.when(F.col("score") >= F.col("cutoff"), F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(F.col("score") >= F.col("cutoff"), F.col("bad")).otherwise(0)).alias("gain")
    )
    strata = tested.groupBy("stratum").agg(F.max("n").alias("n"))
    shared = strata.agg(F.count("*").alias("strata"))
    bound = strata.join(F.broadcast(shared), F.lit(True)).select("stratum", _most_false(F.col("n"), alpha / len(RULES), F.lit(delta) / (F.col("strata") * len(RULES))).alias("most"))
    useful = tested.join(bound, "stratum").where("k <= most and gain > k")
    best = F.max_by("cutoff", F.struct(F.col("gain") - F.col("k"), F.col("cutoff")))
    return useful.groupBy("stratum", "rule").agg(best.alias("cutoff"))


def _wide(cutoffs: DataFrame) -> DataFrame:
    return cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES))


def _judged(measured: DataFrame, cutoffs: DataFrame, stratum: str, score) -> DataFrame:
    wide = materialize(_wide(cutoffs), "cutoffs").withColumnRenamed("stratum", "_of")
    small = wide.limit(_BROADCAST_STRATA + 1).count() <= _BROADCAST_STRATA
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(score(r) >= F.col(f"_cut_{r}"), F.lit(False))
    joined = measured.join(F.broadcast(wide) if small else wide, F.col(stratum) == F.col("_of"), "left")
    return joined.withColumn("_kept", ~score("base_failed") & ~rejected).drop("_of", *(f"_cut_{r}" for r in RULES))


def _stratum(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")


def quality_report(docs: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """Counts and verdict of every document.

    ``docs`` has doc_id, text and, if there, lang (the stratum; null or absent: 'und').
    Defined cases: null and empty texts have no words and fail the base rules; very long texts are
    measured whole; null doc_ids are judged but not labelled; each row gives a row, also one that
    repeats a doc_id (each counts as a labelled one); of cutoffs that gain the same the most lenient
    is used; other columns are ignored whatever their names; empty tables give no rows; without
    enough labels nothing is certified and only the base rules reject.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), _stratum(docs).alias("stratum")]
    measured = materialize(measure(docs.select(*columns, "text")).select("doc_id", "stratum", "_m.*"), "measured")
    judged = _judged(measured, learn_cutoffs(measured, labels, alpha, delta), "stratum", F.col)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, for the cases that :func:`quality_report` defines.

    Each text is measured once: rows are written with their scores, cutoffs are learned from the
    scores, and the written rows are judged. No text is shuffled.
    """
    row = materialize(measure(docs.select(F.struct(*docs.columns).alias("_row"), "text", _stratum(docs).alias("_stratum"), F.col("doc_id").cast("long").alias("_id"))).drop("text"), "scored")
    scores = row.select(F.col("_id").alias("doc_id"), F.col("_stratum").alias("stratum"), "_m.*")
    judged = _judged(row, learn_cutoffs(scores, labels, alpha, delta), "_stratum", lambda c: F.col("_m")[c])
    return judged.where("_kept").select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))
