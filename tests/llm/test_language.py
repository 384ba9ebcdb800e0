"""The learner against a dense one, temperature against a grid, what predictions may depend on, hot ids."""

import numpy as np
from pyspark.sql import functions as F

from sievelake.llm.language import features, fit_temperature, follow_the_regularised_leader, gram_counts, identify_languages, train


def dense(rows, classes, n_classes, columns, alpha, beta, l1, l2, passes):
    """The textbook update, all coordinates of every example."""
    x = np.zeros((len(rows), columns + 1))
    for i, (at, v) in enumerate(rows):
        x[i, at] = v
        x[i, columns] = 1
    z, n = np.zeros((columns + 1, n_classes)), np.zeros((columns + 1, n_classes))
    order = np.random.default_rng(11)

    def weights():
        w = np.zeros_like(z)
        for i in range(columns + 1):
            for c in range(n_classes):
                if abs(z[i, c]) > l1:
                    w[i, c] = -(z[i, c] - np.sign(z[i, c]) * l1) / ((beta + n[i, c] ** 0.5) / alpha + l2)
        return w

    for _ in range(passes):
        for i in order.permutation(len(rows)):
            w = weights()
            s = x[i] @ w
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            for c in range(n_classes):
                g = (p[c] - (c == classes[i])) * x[i]
                sigma = ((n[:, c] + g * g) ** 0.5 - n[:, c] ** 0.5) / alpha
                z[:, c] += g - sigma * w[:, c]
                n[:, c] += g * g
    w = weights()
    return w[:-1], w[-1]


def test_learner_against_a_dense_one():
    rnd = np.random.default_rng(5)
    rows, classes = [], rnd.integers(0, 3, 40)
    for c in classes:
        at = np.sort(rnd.choice(12, 4, replace=False))
        rows.append((at, rnd.random(4) + (at % 3 == c)))
    got, want = follow_the_regularised_leader(rows, classes, 3, 12), dense(rows, classes, 3, 12, 0.5, 1.0, 0.01, 0.01, 3)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])
    strong = follow_the_regularised_leader(rows, classes, 3, 12, l1=2.0)[0]
    assert (strong == 0).sum() > (got[0] == 0).sum()


def test_temperature_against_a_grid():
    rnd = np.random.default_rng(2)
    classes = rnd.integers(0, 4, 500)
    scores = rnd.normal(size=(500, 4)) * 3
    scores[np.arange(500), classes] += 2

    def loss(t):
        s = scores / t
        return (np.log(np.exp(s).sum(1)) - s[np.arange(500), classes]).mean()

    grid = np.exp(np.linspace(-1.5, 4, 3000))
    assert abs(np.log(fit_temperature(scores, classes)) - np.log(grid[np.argmin([loss(t) for t in grid])])) < 0.01
    assert fit_temperature(np.empty((0, 4)), np.empty(0, int)) == 1.0


def test_grams_against_brute_force_of_lengths():
    counts = gram_counts("Ab1 c", 1 << 14)  # one space stands for all that is no letter: ' ab c '
    assert counts.sum() == 6 + 5 + 4
    long = gram_counts("ab c " * 60_000 + "ab", 1 << 14)
    assert long.sum() == 3 * 300_004 - 3 and (long > 0).sum() == (gram_counts("ab c ab c ab", 1 << 14) > 0).sum()
    at, x = features(counts, np.ones(1 << 14))
    assert abs((x * x).sum() - 1) < 1e-9 and len(at) == (counts > 0).sum()


def test_predictions_read_the_text_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    before = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs).where("held_out").collect()}
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.when(held, F.lit("?")).otherwise(F.col("source")))
    after = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(other.selectExpr("*", "1 AS h", "2 AS r", "3 AS score")).where("held_out").collect()}
    assert before == after and len(before) > 20


def test_one_hot_id_trains_once(spark):
    rows = [(1, f"the cat sat on the mat {i}", "en") for i in range(400)] + [(i, "der hund liegt auf dem sofa und bellt", "de") for i in range(2, 40)] + [(i, "the dog runs over the hill", "en") for i in range(40, 80)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=20)
    assert model.languages == ["de", "en"] and model.scores("the hill").argmax() == 1 and model.scores("auf dem sofa").argmax() == 0
