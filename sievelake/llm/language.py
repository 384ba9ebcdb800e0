"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Grams of 1 to 3 characters of the folded text are hashed to a fixed number of columns; a
text is its square-rooted counts times inverse document frequency, scaled to length 1.
Document frequencies are counted over all training texts, in one pass with a bounded vector
of counts a partition. The weights are trained with follow-the-regularised-leader (per-coordinate rates, L1 and
L2 penalties) on a bounded sample of labelled texts, the ``sample`` smallest hashes of
doc_id in each language; a fifth of it is left out of training and fits one temperature.
Prediction reads whole texts and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize
from .symbols import U

#: Samples of more rows than this are joined by a shuffle.
_BROADCAST_ROWS = 1_000_000

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER[ord("a")]:
        for i in range(0x110000):
            if chr(i).isalpha():
                _LETTER[i] = True
    return _LETTER


def gram_counts(text: str, columns: int) -> np.ndarray:
    """Counts of the text's hashed grams of 1 to 3 characters; all that is no letter counts as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 32)
    gap = codes == 32
    codes = np.r_[32, codes[~(gap & np.r_[True, gap[:-1]])], 32].astype(np.uint32)
    total = np.zeros(columns, np.int64)
    for lo in range(0, len(codes), 1 << 18):
        part = codes[max(0, lo - 2) : lo + (1 << 18)].astype(U)
        for n in (1, 2, 3):
            key = np.zeros(max(0, len(part) - n + 1), U)
            for j in range(n):
                key = key * U(0x100000001B3) + part[j : len(part) - n + 1 + j] + U(n)
            key *= U(0x9E3779B97F4A7C15)
            start = (max(0, min(2, lo) - n + 1)) if lo else 0
            total += np.bincount((key[start:] >> U(40)).astype(np.int64) % columns, minlength=columns)
    return total


@dataclass(frozen=True)
class Model:
    """Languages, weights (columns x languages, most of them 0), biases, inverse document frequencies, temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def scores(self, text: str) -> np.ndarray:
        """Calibrated probabilities."""
        at, x = features(gram_counts(text, len(self.idf)), self.idf)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns that are not 0, and their TF-IDF values in a vector of length 1."""
    at = np.flatnonzero(counts)
    x = np.sqrt(counts[at]) * idf[at]
    return at, x / (np.sqrt((x * x).sum()) or 1.0)


def follow_the_regularised_leader(rows: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, n_classes: int, columns: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a multinomial logistic regression, one example at a time."""
    z, n = np.zeros((columns + 1, n_classes)), np.zeros((columns + 1, n_classes))

    def leader(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(11)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, x = np.r_[rows[i][0], columns], np.r_[rows[i][1], 1.0]
            w = leader(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[classes[i]] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = leader(np.arange(columns + 1))
    return w[:-1], w[-1]


def fit_temperature(scores: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least cross-entropy on held-out scores, by golden sections of its logarithm."""
    if not len(scores):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), classes]).mean())

    lo, hi, ratio = -1.5, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(columns: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(columns, np.int64), 0
        for b in batches:
            for t in b["text"].to_pylist():
                df += gram_counts(t, columns) > 0
                n += 1
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.r_[some, -1]), pa.array(np.r_[df[some], n])], ["column", "n"])

    return count


def train(labelled: DataFrame, columns: int = 1 << 14, sample: int = 500) -> Model:
    """Fit a model on (doc_id, text, lang) rows without nulls in text and lang.

    Document frequencies cover all rows; weights and temperature come from ``sample`` rows a
    language (bounded: see the module). The vector of frequencies has ``columns`` numbers.
    """
    counted = labelled.select("text").mapInArrow(_frequencies(columns), "column long, n long").groupBy("column").agg(F.sum("n").alias("n")).toPandas()
    n = int(counted.loc[counted["column"] == -1, "n"].sum())
    df = np.zeros(columns)
    seen = counted[counted["column"] >= 0]
    df[seen["column"].to_numpy()] = seen["n"].to_numpy()
    idf = np.log((1 + n) / (1 + df)) + 1

    # The least hashes of each language. Hashes are even, so all that is sorted are some twice as
    # many as wanted: those under a bound that follows from the language's number of ids.
    ranked = labelled.select("doc_id", "lang", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(5)).alias("h"))
    counts = materialize(ranked.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.05).alias("ids")), "languages")
    share = F.least(F.lit(1.0), (2.0 * sample + 100) / F.col("ids"))
    offered = ranked.join(counts, "lang").where(F.col("h") <= (share - 0.5) * 2.0**64).select("lang", "doc_id", "h").distinct()
    chosen = offered.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= sample).select("doc_id", "lang")
    chosen = materialize(chosen, "training-sample")  # ``sample`` rows a language
    small = chosen.count() <= _BROADCAST_ROWS
    # Rows that repeat a doc_id train once, with the first of their texts.
    wanted = labelled.join(F.broadcast(chosen) if small else chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    grams = wanted.mapInArrow(_sample_rows(idf), "h long, lang string, at binary, x binary").toPandas().sort_values(["h", "lang"], kind="stable")
    languages = sorted(grams["lang"].unique())
    if not languages:
        return Model([], np.zeros((columns, 0)), np.zeros(0), idf, 1.0)
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32).astype(float)) for a, x in zip(grams["at"], grams["x"], strict=True)]
    classes = np.searchsorted(languages, grams["lang"])
    held = grams["h"].to_numpy() % 5 == 0
    if held.all() or not held.any():
        held[:] = False
    own = np.flatnonzero(~held)
    weights, bias = follow_the_regularised_leader([rows[i] for i in own], classes[own], len(languages), columns)
    out = np.flatnonzero(held)
    raw = np.array([rows[i][1] @ weights[rows[i][0]] + bias for i in out]).reshape(len(out), len(languages))
    return Model(languages, weights.astype(np.float32), bias, idf, fit_temperature(raw, classes[out]))


def _sample_rows(idf: np.ndarray):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x, h = [], [], []
            for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                a, v = features(gram_counts(t, len(idf)), idf)
                at.append(a.astype(np.int32).tobytes())
                x.append(v.astype(np.float32).tobytes())
                h.append((int(d or 0) * 0x9E3779B97F4A7C15 >> 7) & 0x7FFFFFFF)
            yield pa.record_batch([pa.array(h, pa.int64()), b["lang"], pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["h", "lang", "at", "x"])

    return make


def _predictions(model: Model):
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lang, score = [], []
            for t in b["text"]:
                if t is None or not any(map(str.isalpha, t)) or not model.languages:
                    lang.append("und")
                    score.append(0.0)
                    continue
                p = model.scores(t)
                best = int(p.argmax())
                lang.append(model.languages[best])
                score.append(float(p[best]))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "lang_pred": lang, "score": score})

    return predict


def held_out(doc_id: Column) -> Column:
    """Every fourth document by crc32 of its id's text never trains."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, columns: int = 1 << 14, sample: int = 500) -> DataFrame:
    """Predicted language of every document, learned from the rows that are not held out.

    ``docs`` has doc_id, text and lang. Defined cases: null texts and texts without a letter are
    'und' with score 0, as is all where nothing was learned; a null doc_id is not held out and
    does not train; rows that repeat a doc_id each give a row and train once a language; very long
    texts are read whole; of equal scores the first language wins; other columns are ignored
    whatever their names; an empty table gives no rows. lang, source and doc_id of a row have no
    part in its prediction.

    Returns doc_id, held_out, lang_pred, score (calibrated probability).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), columns, sample)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(_predictions(model), "doc_id long, held_out boolean, lang_pred string, score double")
