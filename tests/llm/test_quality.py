"""Cutoffs: exact bounds, a planted table on which they decide, false rejection under the risk, texts against SQL."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from sievelake.llm import entries
from sievelake.llm.quality import RULES, _most_false, keep_good, learn_cutoffs, measure, quality_report

DOCS = "doc_id long, text string, lang string"


def most_false(n, alpha, delta):
    """The largest k with P(Binomial(n, alpha) <= k) <= delta, in exact arithmetic."""
    total, k = Fraction(0), -1
    for i in range(n + 1):
        total += math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i)
        if total > delta:
            break
        k = i
    return k


def test_binomial_bound_is_exact(spark):
    cases = [(n, a, d) for n in (1, 50, 573, 574, 575, 900, 1500) for a in ("1/100", "1/10") for d in ("1/320", "1/20")]
    df = spark.createDataFrame([(i, n) for i, (n, _, _) in enumerate(cases)], "i long, n long")
    for a, d in {c[1:] for c in cases}:
        got = {r.i: r.k for r in df.select("i", _most_false(F.col("n"), float(Fraction(a)), F.lit(float(Fraction(d)))).alias("k")).collect()}
        for i, (n, x, y) in enumerate(cases):
            if (x, y) == (a, d):
                assert got[i] == most_false(n, Fraction(a), Fraction(d))


def planted(seed, n=9000, good_rate=0.002):
    """Scores of labelled documents: bad ones have many symbols; a small share of the good ones too."""
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        stratum = "abc"[i % 3] if i % 50 else "few"
        good = rnd.random() < 0.6
        score = rnd.randrange(20, 100) if (not good and rnd.random() < 0.8) or (good and rnd.random() < good_rate) else rnd.randrange(0, 10)
        rows.append((i, stratum, False, score, 0, 0, rnd.randrange(0, 3)))
        labels.append((i, int(good), 0))
    return rows, labels


SCORED = "doc_id long, stratum string, base_failed boolean, symbol_score int, dup_line_score int, repeat_score int, upper_score int"


def brute_cutoffs(rows, labels, alpha, delta):
    good = defaultdict(bool)
    for i, q, _ in labels:
        good[i] |= q > 0
    strata, out = sorted({r[1] for r in rows if r[0] in good}), {}
    for s in strata:
        own = [r for r in rows if r[1] == s and r[0] in good and not r[2]]
        n = sum(good[r[0]] for r in own)
        bound = most_false(n, Fraction(alpha) / len(RULES), Fraction(delta) / (len(RULES) * len(strata)))
        for j, rule in enumerate(RULES):
            best = None
            for c in range(1, 101):
                k, gain = (sum(r[3 + j] >= c and good[r[0]] == g for r in own) for g in (True, False))
                if k <= bound and gain > k and (best is None or (gain - k, c) > best):
                    best = (gain - k, c)
            if best:
                out[s, rule] = best[1]
    return out


def test_cutoffs_of_a_planted_table_against_brute_force(spark):
    rows, labels = planted(4)
    got = learn_cutoffs(spark.createDataFrame(rows, SCORED), spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))
    got = {(r.stratum, r.rule): r.cutoff for r in got.collect()}
    assert got == brute_cutoffs(rows, labels, Fraction(4, 100), Fraction(5, 100))
    assert {s for s, _ in got} == {"a", "b", "c"} and {r for _, r in got} == {"symbol_score"}


def test_false_rejection_stays_under_the_risk(spark):
    # Good documents have high scores at a rate just above what a rule may risk: each cutoff between is an error.
    alpha, delta, runs = 0.04, 0.2, 8
    errors = 0
    for t in range(runs):
        rows, labels = planted(100 + t, 3000, 0.0125)
        cutoffs = learn_cutoffs(spark.createDataFrame(rows, SCORED), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), alpha, delta)
        errors += cutoffs.where("rule = 'symbol_score' and cutoff between 10 and 20").count() > 0
    assert errors <= 3  # each run errs with a chance of 0.2 at most


def test_the_method_rejects_in_a_report(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(2400):
        good = i % 2 == 0
        body = [f"w{rnd.randrange(10**6)}" for _ in range(20)] + ([f"#$#{k}" for k in range(8)] if not good and i % 10 else [])
        rows.append((i, " ".join(body), "en"))
        labels.append((i, int(good), 0))
    rows += [(None, " ".join(f"#$#${i}" for i in range(10)) + " " + " ".join(f"x{i}" for i in range(20)), "en"), (3000, None, None), (3001, " ".join(f"#$#${i}" for i in range(10)) + " " + " ".join(f"x{i}" for i in range(20)), None)]
    docs, of = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_report(docs, of).collect()}
    lost = {i for i, r in got.items() if not r.kept}
    assert lost == {i for i in range(2400) if i % 2 and i % 10} | {None, 3000} and not any(got[i].base_failed for i in lost - {3000})
    extra = docs.selectExpr("*", "1 AS kept", "2 AS _m", "3 AS _row", "4 AS _stratum", "5 AS symbol_score", "6 AS _id")
    kept = keep_good(extra, of)
    assert kept.columns == extra.columns and {r.doc_id for r in kept.collect()} == set(got) - lost
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", of.toPandas())
    want = con.execute(f"SELECT doc_id FROM ({entries.oracle_sql()['op2_quality_rules']}) WHERE NOT kept").fetchall()
    assert {None if x is None or x != x else int(x) for (x,) in want} == lost


def test_each_text_is_measured_once(spark):
    docs = spark.createDataFrame([(1, "a b c", "en")], DOCS)
    assert measure(docs).select("_m.n_words").first()[0] == 3
    kept = keep_good(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert "regexp" not in kept._jdf.queryExecution().optimizedPlan().toString()
