"""Sharding by extendible hashing, in DataFrame functions only.

A shard is a prefix of a hash of doc_id. A bucket that exceeds the byte limit, and only such
a one, splits on its next bit, until every shard fits. Splits are found from sums of bytes by
prefix, a few dozen times as many numbers as there are shards, in one pass; prefixes still too
large at that depth are summed again some bits deeper.

The directory is indexed by as many leading bits as there are shards to tell apart: 2**bits is
at most their number. An entry lists the shards of its prefix by the start of their hash range
(one, or a few where that prefix was split further), so the directory has less than two
places a shard. It is sent to the executors, and a row finds its shard where it lies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import fresh, hash_key, leading_bits
from .store import materialize

_BITS = 60
#: Directories of up to so many shards (some 100 MB) are sent to the executors: 500 TB of text at the
#: default limit. Beyond, rows are joined to the directory by a shuffle.
BROADCAST_SHARDS = 2_000_000


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, _BITS - depth)


def _shifted(kind: str, value: str, by: Column) -> Column:
    return F.call_function(kind, F.col(value), by.cast("int"))


def _hash(doc_id: str = "doc_id") -> Column:
    return leading_bits(hash_key(doc_id), _BITS // 4)


def find_shards(docs: DataFrame, max_bytes: int) -> DataFrame:
    """(depth, prefix, bytes, rows) of every shard of (doc_id, text)."""
    sizes = docs.select(_hash().alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    sizes = materialize(sizes.groupBy("h").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")), "sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    base, depth = 0, min(_BITS, max(0, math.ceil(math.log2(max(1, total / max_bytes)))) + 6)
    found = None
    while True:
        sums = sizes.groupBy(_prefix(F.col("h"), depth).alias("at")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count("*").alias("keys"))
        sums = materialize(sums, "prefix-sums")
        cut = _shifted("shiftright", "at", F.lit(depth) - F.col("depth")).alias("prefix")

        def up(lowest: int, sums: DataFrame = sums, cut: Column = cut, depth: int = depth) -> DataFrame:
            return sums.select("*", F.explode(F.sequence(F.lit(lowest), F.lit(depth))).alias("depth")).select("*", cut)

        tree = up(base).groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.sum("keys").alias("keys"))
        fits = materialize(tree.where((F.col("bytes") <= max_bytes) | (F.col("keys") == 1)).drop("keys"), "fitting")
        # No bucket above the first depth that fits takes part, so no bucket of half the corpus is one key of the join.
        lowest = fits.agg(F.min("depth")).first()[0]
        found_at = up(depth if lowest is None else lowest).select("at", "depth", "prefix").join(fits.hint("merge"), ["depth", "prefix"])
        chosen = found_at.groupBy("at").agg(F.min_by(F.struct("depth", "prefix", "bytes", "rows"), "depth").alias("s"))
        chosen = materialize(sums.select("at").join(chosen.hint("merge"), "at", "left"), "chosen")
        level = chosen.where("s is not null").select("s.*").distinct()
        found = level if found is None else found.unionByName(level)
        over = chosen.where("s is null").select("at")
        if depth == _BITS or over.isEmpty():
            return materialize(found, "shards")
        sizes = sizes.withColumn("at", _prefix(F.col("h"), depth)).join(over.hint("merge"), "at", "left_semi").drop("at")
        base, depth = depth + 1, min(_BITS, depth + 8)


def build_directory(shards: DataFrame) -> tuple[int, DataFrame]:
    """Bits of the index, and (at, places): for each prefix of so many bits its shards (start, depth, bytes, rows), by start."""
    bits = max(1, shards.count()).bit_length() - 1
    gap = F.lit(bits) - F.col("depth")
    above = F.sequence(_shifted("shiftleft", "prefix", gap), _shifted("shiftleft", "prefix", gap) + _shifted("shiftleft", "one", gap) - 1)
    at = F.when(F.col("depth") <= bits, above).otherwise(F.array(_shifted("shiftright", "prefix", -gap)))
    place = F.struct(_shifted("shiftleft", "prefix", F.lit(_BITS) - F.col("depth")).alias("start"), "depth", "bytes", "rows").alias("place")
    spread = shards.withColumn("one", F.lit(1).cast("long")).select(F.explode(at).alias("at"), place)
    return bits, materialize(spread.groupBy("at").agg(F.array_sort(F.collect_list("place")).alias("places")), "directory")


def assign_shards(docs: DataFrame, max_bytes: int = 256 << 20, broadcast_shards: int = BROADCAST_SHARDS) -> DataFrame:
    """``docs`` with shard_id (the shard's hash prefix in binary), shard_depth, shard_bytes and shard_rows; columns of these names are replaced.

    Bytes are those of the UTF-8 text. Defined cases: a null text has none; a null doc_id hashes
    as 'null'; rows of one doc_id stay together, and a doc_id whose rows alone exceed the limit is
    a shard of its own; if all rows fit, the one shard is '' of depth 0; an empty table gives no
    rows; all other columns stay, whatever their names. Up to ``broadcast_shards`` shards no text
    is shuffled; the rows are the same beyond.
    """
    docs = docs.drop("shard_id", "shard_depth", "shard_bytes", "shard_rows")
    bits, directory = build_directory(find_shards(docs, max_bytes))
    h, at, places, place = fresh(docs.columns, "h", "at", "places", "place")
    small = (1 << bits) * 2 <= broadcast_shards
    directory = directory.select(F.col("at").alias(at), F.col("places").alias(places))
    hashed = docs.withColumn(h, _hash()).withColumn(at, _prefix(F.col(h), bits))
    joined = hashed.join(F.broadcast(directory) if small else directory.hint("merge"), at)
    # The last shard of the prefix that starts at the row's hash or before it.
    own = F.element_at(F.filter(places, lambda p: p["start"] <= F.col(h)), -1)
    found = joined.withColumn(place, F.when(F.size(places) == 1, F.get(places, F.lit(0))).otherwise(own))
    depth, start = F.col(place)["depth"], F.col(place)["start"]
    prefix = F.call_function("shiftright", start, (F.lit(_BITS) - depth).cast("int"))
    shard = F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, F.lit("0")))
    return found.select(*docs.columns, shard.alias("shard_id"), depth.cast("int").alias("shard_depth"), F.col(place)["bytes"].alias("shard_bytes"), F.col(place)["rows"].alias("shard_rows"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; each shard is written by one task, which its byte limit bounds (but for a doc_id whose rows exceed it)."""
    sharded.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
