"""Near-dedup by circulant MinHash, banding, exact Jaccard on full sets, and components of the links.

Two permutations make a whole signature: the first places each shingle on a ring, the second
ranks the ring's places; coordinate k of the signature is the least rank at place + k. All
coordinates of a shingle are one contiguous slice of the rank table, so a signature is a
minimum over slices.

1. Documents get the size of their shingle set, a digest of the set, band hashes and a sketch.
2. Documents of equal sets are one class, represented by its smallest doc_id.
3. Band hashes of representatives meet in shards, packed. Each bucket proposes a star, every
   member with the smallest one: linear in the bucket, never its pairs.
4. Proposed pairs are confirmed on full sets; confirmed links give components.
5. Buckets that still hold several components are gone through again in blocks of bounded
   size: members of different components whose sketches agree well enough are compared on full
   sets, and each block gives the components it joins, not its pairs. So a link between
   different texts is lost only if banding never brings them together, or if their sketches
   agree in fewer places than 5.5 standard deviations under the mean of linked ones (about one
   in 50 million).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import discard, group_count, materialize
from .symbols import NOT_SPACE, U, blocks, gram_hash, mix64, text_buffer, word_hashes

#: Places on the ring; the rank table has so many entries.
_RING = 1 << 20


@dataclass(frozen=True)
class Bands:
    """56 bands of 6 coordinates miss a pair of similarity 0.75 once in about 59,000; one of 0.3 meets with chance 0.04, one of 0.1 with 0.00006.

    With rows of 4 such pairs would meet with chance 0.25 and 0.004, and buckets of dissimilar
    texts would grow with the corpus.
    """

    bands: int = 56
    rows: int = 6
    #: Coordinates whose low bytes are kept as a sketch.
    sketch: int = 128

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


_tables: dict[int, np.ndarray] = {}


def rank_table(coordinates: int) -> np.ndarray:
    """The second permutation, its start repeated after its end: slice s..s+K holds all shifts of place s."""
    if coordinates not in _tables:
        rank = np.argsort(mix64(np.arange(_RING, dtype=U) + U(0xC2B2AE3D27D4EB4F)), kind="stable").astype(np.uint32)
        _tables[coordinates] = np.lib.stride_tricks.sliding_window_view(np.r_[rank, rank[: coordinates - 1]], coordinates)
    return _tables[coordinates]


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit shingle hashes (not empty)."""
    table = rank_table(coordinates)
    place = (mix64(shingles ^ U(0xA0761D6478BD642F)) >> U(44)).astype(np.int64)  # the first permutation's high bits
    low = table[place[:256]].min(0)
    for i in range(256, len(place), 256):
        np.minimum(low, table[place[i : i + 256]].min(0), out=low)
    return low


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct hashes of ``words``-word shingles, folded; fewer words: the sequence as one; none: empty."""
    buf, offsets = text_buffer(column)
    for lo, hi in blocks(offsets, 1 << 20):
        at = offsets[lo : hi + 1]
        hashes, before = word_hashes(buf[at[0] : at[-1]], at - at[0], NOT_SPACE, fold=True)
        grams = gram_hash(hashes, words)
        for i in range(hi - lo):
            n = before[i + 1] - before[i]
            if n >= words:
                yield np.unique(grams[before[i] : before[i + 1] - words + 1])
            elif n:
                yield gram_hash(hashes[before[i] : before[i + 1]], int(n)) ^ U(n)
            else:
                yield np.empty(0, U)


_SIGNED = "doc_id long, n_shingles long, digest binary, bands binary, sketch binary"


def _signed(words: int, shape: Bands):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, shape.bands + 1, dtype=U))
        for batch in batches:
            n, digest, bands, sketch = [], [], [], []
            for s in shingle_sets(batch["text"], words):
                n.append(len(s))
                if len(s):
                    low = signature(s, shape.coordinates)
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    folded = salt.copy()
                    for r in low.reshape(shape.bands, shape.rows).T:
                        folded = mix64(folded ^ r.astype(U))
                    bands.append(folded.tobytes())
                    sketch.append((low[: shape.sketch] & 0xFF).astype(np.uint8).tobytes())
                else:
                    digest.append(None)
                    bands.append(None)
                    sketch.append(None)
            yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, bands, sketch))], ["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return sign


def _cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Borders of the buckets in sorted 64-bit keys."""
    return np.searchsorted(keys, np.array([(b << 64) // buckets for b in range(buckets)] , U)).tolist() + [len(keys)]


def _packed(buckets: int, shape: Bands):
    """Band hashes with (doc_id, size, component), packed by the bucket of the band hash."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch["bands"].to_pylist()), U)
            columns = [np.repeat(np.asarray(batch[c]).astype(np.int64), shape.bands) for c in ("doc_id", "n_shingles", "component")]
            order = np.argsort(keys)
            keys, columns = keys[order], [c[order] for c in columns]
            cut = _cut(keys, buckets)
            full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
            blob = [b"".join(x[cut[b] : cut[b + 1]].tobytes() for x in (keys, *columns)) for b in full]
            yield pa.record_batch([pa.array(full, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "payload"])

    return pack


def _opened(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by band hash then doc_id, and the border of each band hash."""
    parts = [np.frombuffer(p, np.int64).reshape(4, -1) for p in t["payload"].to_pylist()]
    keys, docs, sizes, components = np.concatenate(parts, axis=1)
    order = np.lexsort((docs, keys))
    keys = keys[order]
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    return keys, docs[order], sizes[order], components[order], edges


def _stars(similarity: float):
    """Each member of a bucket with its smallest one, where sizes allow; and (doc, doc) for members that some other member's size allows."""

    def propose(t: pa.Table) -> pa.Table:
        keys, docs, sizes, _, edges = _opened(t)
        first = np.repeat(edges[:-1], np.diff(edges))
        a, b = docs[first], docs
        small, large = np.minimum(sizes[first], sizes), np.maximum(sizes[first], sizes)
        ok = (a != b) & (small >= similarity * large)
        by_size = np.lexsort((sizes, keys))
        near = (keys[by_size][1:] == keys[by_size][:-1]) & (sizes[by_size][:-1] >= similarity * sizes[by_size][1:])
        met = docs[by_size][np.r_[near, False] | np.r_[False, near]]
        pairs = np.unique(np.concatenate([np.stack([a[ok], b[ok]], 1), np.stack([met, met], 1)]), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return propose


_OPEN = "band long, doc_id long, component long, n_shingles long, of int"
#: Most members of a block on average, and most bytes of their sets.
_COMPARED, _COMPARED_BYTES = 1024, 16 << 20


def _unsettled(t: pa.Table) -> pa.Table:
    """Members of the buckets that hold several components; ``of`` is the bucket's number of blocks."""
    keys, docs, sizes, components, edges = _opened(t)
    low, high, total = (f(x, edges[:-1]) if len(x) else x for f, x in ((np.minimum.reduceat, components), (np.maximum.reduceat, components), (np.add.reduceat, sizes)))
    n = np.diff(edges)
    of = np.maximum(-(-n // _COMPARED), -(-8 * total // _COMPARED_BYTES))
    x = np.repeat(low != high, n)
    return pa.table({"band": keys[x], "doc_id": docs[x], "component": components[x], "n_shingles": sizes[x], "of": np.repeat(of, n)[x].astype(np.int32)})


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``percent`` / 100 or more."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _close(percent: int, shape: Bands):
    """Components that a link between members of one pair of blocks joins: each with the smallest of its group.

    Only pairs of members still apart whose sizes and sketches allow the similarity are compared,
    on full sets; what comes out is linear in the block's components, never its pairs.
    """
    n, similarity = min(shape.sketch, shape.coordinates), percent / 100
    least = n * similarity - 5.5 * (n * similarity * (1 - similarity)) ** 0.5

    def compare(t: pa.Table) -> pa.Table:
        names, group = np.unique(np.asarray(t["component"].combine_chunks()), return_inverse=True)
        sizes, side = (np.asarray(t[c].combine_chunks()) for c in ("n_shingles", "side"))
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(sizes), n)
        sets = [np.frombuffer(x.as_buffer(), U) for x in t["shingles"]]
        right = np.flatnonzero(side != 0)
        for i in np.flatnonzero(side != 1):
            j = right[(group[right] != group[i]) & (np.minimum(sizes[right], sizes[i]) >= similarity * np.maximum(sizes[right], sizes[i]))]
            for k in j[(sketch[j] == sketch[i]).sum(1) >= least]:
                if group[k] != group[i] and _similar(sets[i], sets[k], percent):
                    keep, gone = sorted((group[i], group[k]))
                    group[group == gone] = keep
        members = np.unique(np.stack([names[group], np.asarray(t["component"].combine_chunks())], 1), axis=0)
        members = members[members[:, 0] != members[:, 1]]
        return pa.table({"a": members[:, 0], "b": members[:, 1]})

    return compare


def _sets(words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array([s.tobytes() for s in shingle_sets(batch["text"], words)], pa.binary())], ["doc_id", "shingles"])

    return make


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), percent) for x, y in zip(batch["left"], batch["right"], strict=True)]
            yield pa.record_batch([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, shape: Bands | None = None) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of ``percent`` / 100 or more of their shingle sets.

    ``docs`` has doc_id and text; other columns are ignored. Texts are folded (A-Z) and cut at
    ASCII white space; a set holds the distinct ``words``-word shingles, or the whole sequence
    where there are fewer words.

    Defined cases: texts without words, or null, have an empty set and are linked with nothing;
    rows with a null doc_id are linked with nothing, their component is null, and they are kept;
    rows that repeat a doc_id should be equal: each is signed, and each gives a row, of the same
    component; very long texts are read whole; the smallest doc_id of a component is kept, so there
    are no ties; an empty table gives no rows.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept.
    """
    shape = shape or Bands()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(docs.mapInArrow(_signed(words, shape), _SIGNED), "signed")
    able = signed.where("digest is not null and doc_id is not null")
    classes = materialize(able.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "classes")
    of = classes.select(F.col("first_id").alias("doc_id"), F.col("digest").alias("of_digest"))
    own = able.join(of, "doc_id").where("digest = of_digest").groupBy("doc_id", "digest")
    heads = materialize(own.agg(F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "heads")
    buckets = group_count(docs, 16 << 20)

    def shards(f, members: DataFrame, schema: str) -> DataFrame:
        return members.mapInArrow(_packed(buckets, shape), "bucket int, payload binary").groupBy("bucket").applyInArrow(f, schema)

    pairs = materialize(shards(_stars(percent / 100), heads.select("doc_id", "n_shingles", "bands", F.col("doc_id").alias("component")), "a long, b long").distinct(), "pairs")
    met = pairs.where("a = b").select(F.col("a").alias("doc_id"))
    # Texts move once, at every size by the same kind of join; only those of documents that met another.
    texts = docs.join(met.hint("merge"), "doc_id").groupBy("doc_id").agg(F.first("text").alias("text"))
    sets = materialize(texts.mapInArrow(_sets(words), "doc_id long, shingles binary"), "sets")
    joined = pairs.where("a <> b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")
    links = materialize(joined.mapInArrow(_confirmed(percent), "a long, b long"), "links")
    components = materialize(connected_components(links), "components")

    # Only documents that met one of an allowed size can have a link that is not yet settled.
    members = heads.join(met, "doc_id", "left_semi").join(components, F.col("doc_id") == F.col("node"), "left")
    rest = materialize(shards(_unsettled, members.select("doc_id", "n_shingles", "bands", F.coalesce("component", "doc_id").alias("component")), _OPEN), "unsettled")
    block = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("of")).cast("int")
    spread = rest.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    spread = spread.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("side", F.when(F.col("i") == F.col("j"), 2).when(F.col("block") == F.col("i"), 0).otherwise(1))
    spread = spread.join(heads.select("doc_id", "sketch"), "doc_id").join(sets, "doc_id").select("band", "i", "j", "side", "component", "n_shingles", "sketch", "shingles")
    more = materialize(spread.groupBy("band", "i", "j").applyInArrow(_close(percent, shape), "a long, b long").distinct(), "more")
    if not more.isEmpty():
        components = materialize(connected_components(links.unionByName(more)), "components")
    discard(heads, pairs, sets, links, rest, more)

    of_class = classes.join(components, F.col("first_id") == F.col("node"), "left").select("digest", F.coalesce("component", "first_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
