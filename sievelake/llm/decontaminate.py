"""Benchmark decontamination over a distributed positional inverted index of the training texts.

The index is partitioned by document: each block of documents (a MB or so of text) holds its
terms, sorted, with the list of positions of each term. It is written once to the shared
folder; a search reads it and never the texts. Terms are 64-bit hashes of folded words.

Windows of the benchmark are cut on the executors and searched in every block at once: all
start from the posting list of their rarest term (by count over the whole corpus), shifted by
its offset in the window, and are intersected with the shifted lists of the other terms from
rare to common; most windows end at their first or second term. Proximity matches start from
the same lists and ask that each further term have a posting within reach; what is left is
read in full. No posting leaves its block, so no term however common gathers in one task. The
windows are sent to the executors in chunks of a bounded size, one at a time; each chunk is
one pass over the index, its finds are written, and its broadcast is released.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .symbols import ALNUM, U, blocks, ranges, text_buffer, word_hashes

_BLOCK = 2 << 20
_INDEX = "block string, doc_id array<long>, before binary, terms binary, counts binary, positions binary"


def _index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # A block's name is its place: what blocks hold may repeat. It is written with the index, so all searches read the same.
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        buf, offsets = text_buffer(batch["text"])
        for lo, hi in blocks(offsets, _BLOCK):
            at = offsets[lo : hi + 1]
            hashes, before = word_hashes(buf[at[0] : at[-1]], at - at[0], ALNUM, fold=True)
            order = np.argsort(hashes, kind="stable")
            by_term = hashes[order]
            first = np.flatnonzero(np.r_[True, by_term[1:] != by_term[:-1]]) if len(by_term) else np.empty(0, np.int64)
            counts = np.diff(np.r_[first, len(by_term)]).astype(np.int32)
            ids = batch["doc_id"].slice(lo, hi - lo)
            row = [before.astype(np.int64).tobytes(), by_term[first].tobytes(), counts.tobytes(), order.astype(np.int32).tobytes()]
            name, number = f"{part}-{number}", number + 1
            yield pa.record_batch(
                [pa.array([name]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in row)],
                ["block", "doc_id", "before", "terms", "counts", "positions"],
            )


def build_index(docs: DataFrame) -> DataFrame:
    """Positional index of (doc_id, text), stored in the shared folder: one row a block of documents."""
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index_blocks, _INDEX), "positional-index")


def _cut_windows(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch["text"])
            terms, before = word_hashes(buf, offsets, ALNUM, fold=True)
            n = np.diff(before)
            own = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
            row = np.repeat(np.arange(len(n)), own)
            starts = ranges(before[:-1], own)
            content = [terms[x : min(x + window, before[r + 1])].tobytes() for x, r in zip(starts, row, strict=True)]
            yield pa.record_batch([batch["item_id"].take(pa.array(row)), pa.array(content, pa.binary())], ["item_id", "terms"])

    return cut


def benchmark_windows(benchmark: DataFrame, window: int, unnamed: bool = False) -> DataFrame:
    """Distinct (item_id, terms), stored; an item of fewer words than a window is one window. Items without an id only if ``unnamed``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null" if unnamed else "item_id is not null and text is not null")
    return materialize(items.mapInArrow(_cut_windows(window), "item_id long, terms binary").distinct(), "benchmark-windows")


@dataclass(frozen=True)
class _Chunk:
    """Windows of one pass: item of each (and whether it has an id), the chunk's terms, each window's places among them, lengths, and offsets from rare to common."""

    items: np.ndarray
    named: np.ndarray
    terms: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    rank: np.ndarray


def _load(part: DataFrame, window: int) -> _Chunk:
    t = part.toArrow()
    items = t["item_id"].combine_chunks()
    flat = np.frombuffer(b"".join(t["terms"].to_pylist()), U)
    lengths = np.array([len(x) // 8 for x in t["terms"].to_pylist()], np.int64)
    terms, at = np.unique(flat, return_inverse=True)
    windows = np.zeros((len(lengths), window), np.int64)
    windows[np.arange(window)[None, :] < lengths[:, None]] = at
    return _Chunk(np.asarray(pa.compute.fill_null(items, 0)).astype(np.int64), ~np.asarray(pa.compute.is_null(items)), terms, windows, lengths, np.empty((0, window), np.int64))


def _ranked(chunk: _Chunk, df: np.ndarray) -> _Chunk:
    """The windows whose terms all occur somewhere, with their offsets ordered from the rarest term on."""
    window = chunk.windows.shape[1]
    seen = df[chunk.windows] if len(df) else np.empty((0, window), np.int64)
    seen[np.arange(window)[None, :] >= chunk.lengths[:, None]] = np.iinfo(np.int64).max
    x = seen.min(1, initial=np.iinfo(np.int64).max) > 0
    return _Chunk(chunk.items[x], chunk.named[x], chunk.terms, chunk.windows[x], chunk.lengths[x], np.argsort(seen[x], axis=1, kind="stable"))


def _term_counts(terms: Broadcast):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = terms.value
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for t, n in zip(b["terms"], b["counts"], strict=True):
                own, count = np.frombuffer(t.as_buffer(), U), np.frombuffer(n.as_buffer(), np.int32)
                at = np.minimum(np.searchsorted(own, wanted), max(0, len(own) - 1))
                if len(own):
                    total += np.where(own[at] == wanted, count[at], 0)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["term", "n"])

    return count


class _Postings:
    """The posting lists of one block, and the chunk's windows whose terms it has."""

    def __init__(self, r: dict, chunk: _Chunk):
        self.before = np.frombuffer(r["before"], np.int64)
        own = np.frombuffer(r["terms"], U)
        self.counts = np.frombuffer(r["counts"], np.int32).astype(np.int64)
        self.positions = np.frombuffer(r["positions"], np.int32).astype(np.int64)
        self.begin = np.cumsum(self.counts) - self.counts
        self.own, self.chunk, self.n = own, chunk, len(self.positions)
        self.doc_of = np.repeat(np.arange(len(self.before) - 1), np.diff(self.before))
        at = np.minimum(np.searchsorted(own, chunk.terms), max(0, len(own) - 1))
        term = np.where(own[at] == chunk.terms, at, -1) if len(own) else np.full(len(chunk.terms), -1)
        self.windows = term[chunk.windows] if len(chunk.windows) else np.empty(chunk.windows.shape, np.int64)
        unused = np.arange(chunk.windows.shape[1])[None, :] >= chunk.lengths[:, None]
        self.able = np.flatnonzero(((self.windows >= 0) | unused).all(1))
        #: All postings in one sorted list, (term, position) as a number.
        self.all = np.repeat(np.arange(len(own)), self.counts) * (self.n + 1) + self.positions

    def rarest(self, able: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest term) for all postings of that term."""
        t = self.windows[able, self.chunk.rank[able, 0]]
        return np.repeat(able, self.counts[t]), self.positions[ranges(self.begin[t], self.counts[t])]

    def next_from(self, which: np.ndarray, offset: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The first posting, at a position or after it, of the term at an offset of the window; -1 if there is none."""
        base = self.windows[which, offset] * (self.n + 1)
        at = np.searchsorted(self.all, base + position)
        found = self.all[np.minimum(at, len(self.all) - 1)] - base
        return np.where((at < len(self.all)) & (found <= self.n), found, -1)

    def exact(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its first word) of all occurrences."""
        lengths, rank = self.chunk.lengths, self.chunk.rank
        which, place = self.rarest(self.able)
        start = place - rank[which, 0]
        ok = (start >= 0) & (start + lengths[which] <= self.n)
        which, start = which[ok], start[ok]
        for j in range(1, rank.shape[1]):
            if not len(which):
                break
            offset = rank[which, j]
            wanted = np.where(lengths[which] > j, start + offset, 0)
            keep = (lengths[which] <= j) | (self.next_from(which, np.where(lengths[which] > j, offset, 0), wanted) == wanted)
            which, start = which[keep], start[keep]
        same = self.doc_of[start] == self.doc_of[start + lengths[which] - 1] if len(which) else np.empty(0, bool)
        return which[same], start[same]

    def near(self, slop: int, known: set[tuple[int | None, int]]) -> set[tuple[int | None, int]]:
        """(item, row) with all words of a window, as often as it has them, within its length and ``slop`` more words; ``known`` are so already."""
        c, out = self.chunk, set(known)
        which, place = self.rarest(self.able[c.lengths[self.able] > 1])
        for j in range(1, c.rank.shape[1]):
            if not len(which):
                break
            go = c.lengths[which] > j
            reach = c.lengths[which] + slop - 1
            low = np.maximum(place - reach, self.before[self.doc_of[place]])
            high = np.minimum(place + reach, self.before[self.doc_of[place] + 1] - 1)
            found = self.next_from(which, np.where(go, c.rank[which, j], 0), low)
            keep = ~go | ((found >= 0) & (found <= high))
            which, place = which[keep], place[keep]
        if not len(which):
            return out
        term_at = np.empty(self.n, np.int64)
        term_at[self.positions] = np.repeat(np.arange(len(self.own)), self.counts)
        for w, p, d in zip(which.tolist(), place.tolist(), self.doc_of[place].tolist(), strict=True):
            item = int(c.items[w]) if c.named[w] else None
            if (item, d) not in out:
                span = int(c.lengths[w]) + slop
                low, high = max(p - span + 1, int(self.before[d])), min(p + span, int(self.before[d + 1]))
                if _within(term_at[low:high].tolist(), self.windows[w, : c.lengths[w]].tolist(), span):
                    out.add((item, d))
        return out


def _within(words: list[int], wanted: list[int], span: int) -> bool:
    """Whether some ``span`` consecutive words (or all, if fewer) hold the wanted ones, each as often as it is wanted."""
    need = Counter(wanted)
    missing = len(wanted)
    for i, word in enumerate(words):
        if word in need:
            missing -= need[word] > 0
            need[word] -= 1
        if i >= span and words[i - span] in need:
            need[words[i - span]] += 1
            missing += need[words[i - span]] > 0
        if not missing:
            return True
    return False


_HITS = "block string, row int, doc_id long, n_words long, spans array<long>, items array<long>, near array<long>"


def _ids(found: set[int | None]) -> list[int | None]:
    return sorted(found - {None}) + [None] * (None in found)


def _matches(sent: Broadcast, slop: int | None, all_rows: bool):
    """Rows of a block with what of the chunk they hold; without ``all_rows`` only those that hold something."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                p = _Postings(r, chunk)
                which, start = p.exact()
                n = len(r["doc_id"])
                spans: list = [[] for _ in range(n)]
                found: list = [set() for _ in range(n)]
                close: list = [set() for _ in range(n)]
                for d in np.unique(p.doc_of[start]) if len(start) else ():
                    x = p.doc_of[start] == d
                    step = np.zeros(p.before[d + 1] - p.before[d] + 1, np.int64)
                    np.add.at(step, start[x] - p.before[d], 1)
                    np.add.at(step, start[x] - p.before[d] + chunk.lengths[which[x]], -1)
                    hit = np.diff(np.r_[0, (np.cumsum(step) > 0).astype(np.int8)])
                    spans[d] = np.sort(np.r_[np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)]).tolist()
                    own = np.unique(which[x])
                    found[d] = set(chunk.items[own[chunk.named[own]]].tolist()) | ({None} if not chunk.named[own].all() else set())
                if slop is not None and len(p.able):
                    for item, d in p.near(slop, {(i, d) for d in range(n) for i in found[d]}):
                        close[d].add(item)
                rows = range(n) if all_rows else [d for d in range(n) if found[d] or close[d]]
                columns = [[r["block"]] * len(rows), list(rows), [r["doc_id"][d] for d in rows], [int(p.before[d + 1] - p.before[d]) for d in rows]]
                columns += [[spans[d] for d in rows], [_ids(found[d]) for d in rows], [_ids(close[d]) for d in rows]]
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * 3
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "row", "doc_id", "n_words", "spans", "items", "near"])

    return match


def search_index(index: DataFrame, benchmark: DataFrame, window: int = 10, chunk_bytes: int = 16 << 20, unnamed: bool = False, slop: int | None = None) -> DataFrame:
    """All exact occurrences of the benchmark's windows, and with ``slop`` the items near.

    Returns one row a document: block, row (its place in the index), doc_id, n_words, spans (flat
    starts and ends, in words, of its maximal covered runs), items (ids found, sorted; a null at
    the end for those without one) and near (the same for items with a window all of whose words
    stand, in any order, within its length and ``slop`` more words; exact ones are near too).
    """
    spark = index.sparkSession
    windows = benchmark_windows(benchmark, window, unnamed)
    chunks = max(1, -(-windows.count() * 8 * window // chunk_bytes))
    number = F.pmod(F.xxhash64("item_id", "terms"), F.lit(chunks))
    parts = []
    for i in range(chunks):
        chunk = _load(windows.where(number == i), window)
        terms = spark.sparkContext.broadcast(chunk.terms)
        counted = index.select("terms", "counts").mapInArrow(_term_counts(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # one row a term of the chunk at most
        terms.unpersist()
        df = np.zeros(len(chunk.terms), np.int64)
        df[counted["term"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
        sent = spark.sparkContext.broadcast(_ranked(chunk, df))
        if chunks == 1:
            return index.mapInArrow(_matches(sent, slop, True), _HITS)
        parts.append(materialize(index.mapInArrow(_matches(sent, slop, False), _HITS), "finds"))
        sent.unpersist()
    none = spark.sparkContext.broadcast(_ranked(_load(windows.limit(0), window), np.empty(0, np.int64)))
    out = index.mapInArrow(_matches(none, None, True), _HITS)  # a row for documents without any
    for part in parts:
        out = out.unionByName(part)
    flat = {c: F.flatten(F.collect_list(c)) for c in ("spans", "items", "near")}
    gathered = out.groupBy("block", "row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), flat["spans"].alias("spans"),
        *(F.array_sort(F.array_distinct(flat[c])).alias(c) for c in ("items", "near")),
    )
    return gathered.mapInArrow(_merge_spans, _HITS)


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for flat in b["spans"].to_pylist():
            merged: list[int] = []
            for lo, hi in sorted(zip(flat[::2], flat[1::2], strict=True)):
                if merged and lo <= merged[-1]:
                    merged[-1] = max(merged[-1], hi)
                else:
                    merged += [lo, hi]
            out.append(merged)
        yield b.set_column(b.schema.get_field_index("spans"), "spans", pa.array(out, pa.list_(pa.int64())))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, unnamed: bool = False, slop: int | None = None) -> DataFrame:
    """Which words of each document stand in an exact occurrence of a benchmark window, and with ``slop`` which items are near.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored.
    Words are runs of digits, ASCII letters (folded) and anything outside ASCII. An item of
    fewer words than a window is one window; one without words has none.

    Defined cases: null and empty texts have no words; items with a null id are ignored, or if
    ``unnamed`` searched too: they count as one item that the digests do not list; items of one id
    count once; each row of ``docs`` gives a row, whatever its doc_id and however often it is
    repeated; a very long text is a block of its own; an empty benchmark hits nothing; an empty
    ``docs`` gives no rows.

    Returns doc_id, n_words, n_hit, n_items, items_sha256 (ids as strings, sorted as strings,
    comma-joined), contaminated, spans, and with ``slop`` n_near and near_sha256.
    """
    hits = search_index(build_index(docs), benchmark, window, unnamed=unnamed, slop=slop)

    def digest(c: str):
        return F.sha2(F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ","), 256)

    ends = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = [F.col("doc_id"), F.col("n_words"), ends.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest("items").alias("items_sha256"), (ends > 0).alias("contaminated"), F.col("spans")]
    if slop is not None:
        out += [F.size("near").cast("long").alias("n_near"), digest("near").alias("near_sha256")]
    return hits.select(out)
