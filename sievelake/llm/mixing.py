"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A document of a source whose target rate is r appears a Poisson(r) number of times: a hash
of its id, seeded, gives a uniform number, and the count is where that number falls in the
Poisson distribution (inversion). Copies are then dealt and sorted by another hash, which is
a global shuffle with a fixed outcome. Counts depend on the row alone, so a lost task gives
the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import fresh, hash_key, leading_bits, log_gamma
from .store import group_count, materialize

#: Distributions of up to so many steps together (24 MB) are sent to all executors; more are joined by a shuffle.
BROADCAST_STEPS = 3_000_000
#: In that shuffle, parts that each source's rows are dealt to.
_SALTS = 64
#: Copies of a row that are made at once.
_AT_ONCE = 1000


def _uniform(key: Column) -> Column:
    return leading_bits(key, 13) / F.lit(float(1 << 52))


def _distributions(rates: DataFrame) -> DataFrame:
    """(_source, rate, first, steps): P(count <= k) for k = first, first + 1, ... until the rest is under 1e-16.

    Counts below ``first``, 12 standard deviations under the mean, have less than that together.
    The sums run in a window, so the work is linear in the number of steps.
    """
    rate = F.col("rate")
    first = F.greatest(F.lit(0), F.floor(rate - 12 * F.sqrt(rate) - 30)).cast("long")
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("long")
    rows = rates.withColumn("first", first).withColumn("k", F.explode(F.sequence("first", most)))
    chance = F.when(rate > 0, F.exp(F.col("k") * F.ln(rate) - rate - log_gamma(F.col("k") + 1.0))).otherwise((F.col("k") == 0).cast("double"))
    upto = Window.partitionBy("_source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("p", F.sum(chance).over(upto))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"])
    return summed.groupBy("_source").agg(F.first("rate").alias("rate"), F.first("first").alias("first"), steps.alias("steps"))


def target_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(_source, rate, first, steps): the mean number of times that a document of the source appears, and its distribution.

    The weights say how large a share of ``epochs`` times all rows each source gets; sources that
    they leave out get none. Without weights, shares go by the square root of a source's rows. A
    null source is the source '<null>'.
    """
    counts = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("<null>")).alias("_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.sqrt(F.col("n").cast("double")))
    else:
        if any(not 0 <= w < float("inf") for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in sorted(weights.items())] or [("", 0.0)], "_source string, w double")
        weighed = counts.join(given, "_source", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    weighed = materialize(weighed, "weights")
    total = weighed.agg(F.sum("n"), F.sum("w")).first()
    all_rows, all_weights = float(total[0] or 0), float(total[1] or 0) or 1.0
    rate = F.col("w") / all_weights * (all_rows * epochs) / F.col("n")
    return materialize(_distributions(weighed.select("_source", rate.alias("rate"))), "rates")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = "mix-1", broadcast_steps: int = BROADCAST_STEPS) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in a global random order.

    ``docs`` has doc_id and source; all columns stay, whatever their names. Adds ``copy`` (1, 2,
    ...), which replaces a column of that name. Defined cases: a null source is a source of its
    own; a null doc_id hashes as 'null', rows that repeat a doc_id get the same count; null and
    very long texts pass unread; an empty table gives no rows; without any positive weight no row
    stays. A source of few rows and a large weight gets a high rate: its rows are repeated as
    often as that says, some at a time, with no limit.
    """
    rates = target_rates(docs, weights, epochs)
    docs = docs.drop("copy")
    own = docs.columns
    source, first, steps, u, n, block, place, salt = fresh([*own, "copy"], "source_", "first", "steps", "u", "count", "block", "place", "salt")
    rates = rates.select(F.col("_source").alias(source), F.col("first").alias(first), F.col("steps").alias(steps))
    keyed = docs.withColumn(source, F.coalesce(F.col("source").cast("string"), F.lit("<null>")))
    if (rates.agg(F.sum(F.size(steps) + 4)).first()[0] or 0) <= broadcast_steps:
        joined = keyed.join(F.broadcast(rates), source)
    else:
        keyed = keyed.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int"))
        joined = keyed.join(rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).hint("merge"), [source, salt])
    counted = joined.withColumn(u, _uniform(hash_key(F.lit(seed), "doc_id")))
    below = F.size(F.filter(steps, lambda p: F.col(u) >= p))
    counted = counted.select(*own, (F.col(first) + below).alias(n)).where(F.col(n) > 0)
    blocks = counted.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / _AT_ONCE))))
    low = F.col(block) * _AT_ONCE + 1
    copies = blocks.withColumn("copy", F.explode(F.sequence(low.cast("int"), F.least(F.col(n), low + _AT_ONCE - 1).cast("int"))))
    order = hash_key(F.lit(seed + "-order"), "doc_id", "copy")
    parts = group_count(docs, 16 << 20)
    return copies.withColumn(place, order).repartition(parts, place).sortWithinPartitions(place).select(*own, "copy")
