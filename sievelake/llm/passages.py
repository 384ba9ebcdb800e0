"""Finding passages of L symbols that repeat across documents, without comparing all with all.

Two operators stand on this: substring dedup on words (suffix automata) and on bytes
(suffix arrays). Both must know, for each window of L symbols, whether its sequence also
starts in a document with a smaller id. Neither a reference of bounded size nor all
positions of the corpus in one sort is available, so the work is routed:

1. Documents are dealt by a hash of their id into groups of a few MB; that exchange is
   made once and read by all passes. Exact copies of a whole text are found by digest.
2. Each window has a minimizer, the smallest hash among its k-grams; equal windows have
   equal minimizers. A group sends each distinct minimizer once, with its number of
   documents; those met in two documents or more go back to the groups that hold them.
3. Runs of windows that share such a minimizer are *contexts*. A group sends each
   distinct context once, with its smallest doc_id, to the shard of its minimizer. There
   the operator's own structure (automaton or suffix array) resolves the contexts of a
   minimizer against each other: for each it tells which windows stand in an earlier
   document than the context's first, and which stand in that first document or an earlier
   one, which is what later holders of an equal context lose. Minimizers found in more than
   ``hot`` documents would make a large shard: each of their windows is a context of its
   own, routed by its digest, so that equal windows meet and nothing else does. The same
   structure resolves them.
4. What is covered goes back to the groups, which cut their documents.

What is decided without the structure: whole copies of a text (SHA-256). Equal contexts are
told by 128 bits, on the way to the shard and back.

Skew: each group sends a minimizer or a context once however often it has it, so copies of
one passage in a third of all documents give one small entry a group. Memory: groups and
shards are bounded by ``group_count``; a shard resolves one minimizer of at most ``hot``
contexts at a time.

Disk: the larger the corpus, the larger the share of contexts that some other document has
too, and each travels with its symbols. Entries therefore travel in compressed blobs, hashes
as the gaps between them, and the shard computes the digests of contexts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import group_count, materialize
from .symbols import (
    BYTE_VALUE,
    NOT_SPACE,
    U,
    blocks,
    gram_hash,
    mix64,
    prefix_hash,
    ranges,
    slice_hash,
    sliding_min,
    text_buffer,
    word_hashes,
)

#: Windows of one context at most: a mask of them has 64 bits.
_RUN = 64
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Scheme:
    """What a symbol is (``word`` or ``byte``), the window's length, the gram's length, and how contexts are resolved."""

    unit: str
    length: int
    gram: int
    #: (content, begin, windows, minimizer and doc, which are held again, length) to two masks of each context; see ``passages``.
    resolve: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]
    hot: int = 1024


def _values(unit: str, symbols: np.ndarray) -> np.ndarray:
    return BYTE_VALUE[symbols] if unit == "byte" else symbols


def _symbols(unit: str, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols as they are compared, as they are hashed, and the number of symbols before each row."""
    if unit == "byte":
        return buf, _values(unit, buf), offsets
    hashes, before = word_hashes(buf, offsets, NOT_SPACE)
    return hashes, hashes, before


def _runs(scheme: Scheme, values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of some rows: first window, number of windows, row, routing hash of the minimizer."""
    none = np.empty(0, np.int64)
    n, w = len(values), scheme.length - scheme.gram + 1
    if n < scheme.length:
        return none, none, none, np.empty(0, U)
    row = np.repeat(np.arange(len(before) - 1, dtype=np.int32), np.diff(before))
    low = sliding_min(gram_hash(values, scheme.gram), w)
    valid = row[: len(low)] == row[scheme.length - 1 :]  # such windows hold no gram across a border
    new = valid.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1] | (row[1 : len(low)] != row[: len(low) - 1])
    starts = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    lengths = np.flatnonzero(stop) + 1 - starts
    if len(lengths) and lengths.max() > _RUN:
        parts = -(-lengths // _RUN)
        shift = ranges(np.zeros(len(parts), np.int64), parts) * _RUN
        starts, lengths = np.repeat(starts, parts) + shift, np.minimum(_RUN, np.repeat(lengths, parts) - shift)
    return starts, lengths, row[starts], mix64(low[starts]) >> U(16)


def _dealt(h48: np.ndarray, buckets: int) -> np.ndarray:
    """Borders of the buckets in a sorted array of 48-bit hashes."""
    return np.searchsorted(h48, (np.arange(buckets + 1, dtype=object) * (1 << 48) // buckets).astype(U))


def _classes(k1: np.ndarray, k2: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For equal pairs of keys: the place of the smallest doc, whether there are several docs, and each place's class."""
    order = np.lexsort((docs, k2, k1))
    a, b, d = k1[order], k2[order], docs[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(a)] - 1
    member = np.empty(len(a), np.int64)
    member[order] = np.cumsum(new) - 1
    return order[begin], d[begin] != d[end] if len(a) else np.empty(0, bool), member


_CONTROL = "g int, kind string, payload binary"
_ROUTED = "bucket int, g int, kind string, payload binary"


def _table(g, kind, payload, bucket=None) -> pa.Table:
    columns = {"g": pa.array(g, pa.int32()), "kind": pa.array(kind, pa.string()), "payload": pa.array(payload, pa.binary())}
    if bucket is not None:
        columns = {"bucket": pa.array(bucket, pa.int32())} | columns
    return pa.table(columns)


def _row_key(ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return mix64(mix64(ids.view(U)) ^ mark)


def _as_control(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = _row_key(np.asarray(b["doc_id"]).astype(np.int64), np.asarray(b["mark"]).astype(np.int64).view(U))
        yield pa.record_batch([b["g"], pa.array(["copy"] * len(keys)), pa.array([k.tobytes() for k in keys], pa.binary())], ["g", "kind", "payload"])


class _Group:
    """One group of documents with what the other side told it."""

    def __init__(self, scheme: Scheme, docs: pa.Table, told: pa.Table):
        docs = docs.sort_by([("doc_id", "ascending")])
        self.scheme, self.docs = scheme, docs
        self.buf, self.offsets = text_buffer(docs["text"])
        ids = docs["doc_id"].combine_chunks()
        self.null = np.asarray(pa.compute.is_null(ids))
        self.ids = np.asarray(pa.compute.fill_null(ids, 0)).astype(np.int64)
        self.told = [(k, p) for k, p in zip(told["kind"].to_pylist(), told["payload"].to_pylist(), strict=True)]
        mark = np.asarray(docs["mark"].combine_chunks()).view(U)
        #: Rows that are later copies of a whole text; a row is told by its id and the mark of its text.
        self.copy = ~self.null & np.isin(_row_key(self.ids, mark), np.frombuffer(b"".join(self.payloads("copy")), U))
        #: Rows that take part: with an id, and not a later copy.
        self.own = ~self.null & ~self.copy

    def payloads(self, kind: str) -> list[bytes]:
        return [p for k, p in self.told if k == kind]

    def hashes(self, kind: str) -> np.ndarray:
        return np.unique(np.concatenate([np.empty(0, U), *map(_unpack48, self.payloads(kind))]))

    def parts(self) -> Iterator[tuple]:
        """Rows lo..hi at a time: their symbols and contexts; only rows that take part have contexts."""
        for lo, hi in blocks(self.offsets, _BLOCK):
            at = self.offsets[lo : hi + 1]
            symbols, values, before = _symbols(self.scheme.unit, self.buf[at[0] : at[-1]], at - at[0])
            starts, lengths, rows, h = _runs(self.scheme, values, before)
            keep = self.own[lo:hi][rows] if len(rows) else np.empty(0, bool)
            yield lo, hi, symbols, values, before, starts[keep], lengths[keep], rows[keep] + lo, h[keep]


def _keys(scheme: Scheme, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each context's symbols, 64 bits each."""
    ends = starts + lengths + scheme.length - 1
    return mix64(slice_hash(prefix_hash(values), starts, ends) ^ h), slice_hash(prefix_hash(mix64(values)), starts, ends)


def _cooled(scheme: Scheme, hot: np.ndarray, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts, those of hot minimizers cut into single windows that are routed by their own digest."""
    burning = np.isin(h, hot) if len(hot) else np.zeros(len(h), bool)
    if not burning.any():
        return starts, lengths, rows, h
    at = ranges(starts[burning], lengths[burning])
    own = slice_hash(prefix_hash(values), at, at + scheme.length) >> U(16)
    rest = ~burning
    return np.r_[starts[rest], at], np.r_[lengths[rest], np.ones(len(at), lengths.dtype)], np.r_[rows[rest], np.repeat(rows[burning], lengths[burning])], np.r_[h[rest], own]


def _minimizers(scheme: Scheme, buckets: int):
    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], [], [], [])
        g, hs, ds = docs["g"][0].as_py(), [], []
        group = _Group(scheme, docs, told)
        for *_, rows, h in group.parts():
            key = np.unique(np.rec.fromarrays([h, group.ids[rows]])) if len(h) else None
            if key is not None:
                hs.append(key.f0)
                ds.append(key.f1)
        if not hs:
            return _table([], [], [], [])
        h, d = np.concatenate(hs), np.concatenate(ds)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
        h, n = np.unique(h[new], return_counts=True)
        cut = _dealt(h, buckets)
        full = np.flatnonzero(np.diff(cut))
        blob = [_join(_pack48(h[cut[b] : cut[b + 1]]), _planes(np.minimum(n[cut[b] : cut[b + 1]], 65535).astype(np.uint16))) for b in full]
        return _table([g] * len(full), ["h"] * len(full), blob, full)

    return send


def _squeeze(raw: bytes) -> bytes:
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _expand(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]), codec="zstd", asbytes=True)


def _join(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def _split(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(blob, np.int64, n, 8))
    return [blob[a:b] for a, b in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)]


def _planes(x: np.ndarray) -> bytes:
    """Integers as all their first bytes, then all their second ones and so on, compressed."""
    return _squeeze(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _from_planes(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_expand(blob), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack48(h: np.ndarray) -> bytes:
    """Sorted hashes as gaps, whose three low bytes are noise and stay as they are."""
    gaps = h.copy()
    gaps[1:] -= h[:-1]
    octets = gaps.view(np.uint8).reshape(-1, 8)
    return _join(octets[:, :3].tobytes(), _planes((gaps >> U(24)).astype(np.uint32)))


def _unpack48(blob: bytes) -> np.ndarray:
    low, high = _split(blob)
    octets = np.zeros((len(low) // 3, 8), np.uint8)
    octets[:, :3] = np.frombuffer(low, np.uint8).reshape(-1, 3)
    return np.cumsum(octets.view(U).ravel() | (_from_planes(high, np.uint32).astype(U) << U(24)), dtype=U)


def _repeated(hot: int):
    def find(t: pa.Table) -> pa.Table:
        blobs = [_split(b) for b in t["payload"].to_pylist()]
        each = [_unpack48(h) for h, _ in blobs]
        n = np.concatenate([_from_planes(n, np.uint16) for _, n in blobs]).astype(np.int64)
        h = np.concatenate(each)
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        total = np.add.reduceat(n, first)
        many = total >= 2
        h, total = h[first][many], total[many]
        gs, kinds, out = [], [], []
        for g, own in zip(t["g"].to_pylist(), each, strict=True):
            at = np.searchsorted(h, own)
            at[at == len(h)] = 0
            hit = (h[at] == own) if len(h) else np.zeros(len(own), bool)
            for kind, x in (("warm", own[hit]), ("hot", own[hit][total[at[hit]] > hot] if hit.any() else own[:0])):
                if len(x):
                    gs.append(g)
                    kinds.append(kind)
                    out.append(_pack48(x))
        return _table(gs, kinds, out)

    return find


#: In the byte of a context's number of windows: several documents of its group hold it.
_SEVERAL = 128


def _contexts(scheme: Scheme, buckets: int):
    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], [], [], [])
        g = docs["g"][0].as_py()
        group = _Group(scheme, docs, told)
        out: list[tuple[int, str, bytes]] = [(g % buckets, k, p) for k, p in group.told if k in ("copy", "hot")]
        warm, hot = group.hashes("warm"), group.hashes("hot")
        found: list[tuple] = []
        for _, _, symbols, values, _, starts, lengths, rows, h in group.parts() if len(warm) else ():
            hit = np.isin(h, warm)
            starts, lengths, rows, h = _cooled(scheme, hot, values, starts[hit], lengths[hit], rows[hit], h[hit])
            if len(starts):
                k1, k2 = _keys(scheme, values, starts, lengths, h)
                d = group.ids[rows]
                first, several, _ = _classes(k1, k2, d)
                span = lengths[first] + scheme.length - 1
                found.append((h[first], k1[first], k2[first], d[first], several, lengths[first], symbols[ranges(starts[first], span)], span))
        if found:
            h, k1, k2, d, several, lengths, content, span = (np.concatenate(x) for x in zip(*found, strict=True))
            begin = np.cumsum(span) - span
            first, more, member = _classes(k1, k2, d)
            more |= np.bincount(member, several, len(first)) > 0
            order = np.argsort(h[first], kind="stable")
            first, more = first[order], more[order]
            cut = _dealt(h[first], buckets)
            for b in np.flatnonzero(np.diff(cut)):
                part = slice(cut[b], cut[b + 1])
                x = first[part]
                numbers = lengths[x].astype(np.uint8) | np.where(more[part], _SEVERAL, 0).astype(np.uint8)
                out.append((int(b), "c", _join(_pack48(h[x]), _planes(d[x]), _planes(numbers), _squeeze(content[ranges(begin[x], span[x])].tobytes()))))
        return _table([g] * len(out), [k for _, k, _ in out], [p for _, _, p in out], [b for b, _, _ in out])

    return send


def _shard(scheme: Scheme):
    dtype = np.uint8 if scheme.unit == "byte" else U

    def resolve(t: pa.Table) -> pa.Table:
        gs, kinds, out = [], [], []

        def back(g: int, kind: str, payload: bytes) -> None:
            gs.append(g)
            kinds.append(kind)
            out.append(payload)

        found = []
        for g, kind, p in zip(t["g"].to_pylist(), t["kind"].to_pylist(), t["payload"].to_pylist(), strict=True):
            if kind == "c":
                h, d, numbers, content = _split(p)
                h = _unpack48(h)
                found.append((np.full(len(h), g, np.int32), h, _from_planes(d, np.int64), _from_planes(numbers, np.uint8), np.frombuffer(_expand(content), dtype)))
            else:
                back(g, kind, p)
        if found:
            g, h, d, numbers, content = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            several, lengths = numbers >= _SEVERAL, (numbers & (_SEVERAL - 1)).astype(np.int64)
            offsets = np.r_[0, np.cumsum(lengths + scheme.length - 1)]
            begin = offsets[:-1]
            k1, k2 = np.empty(len(h), U), np.empty(len(h), U)
            for lo, hi in blocks(offsets, _BLOCK):
                part = content[offsets[lo] : offsets[hi]]
                k1[lo:hi], k2[lo:hi] = _keys(scheme, _values(scheme.unit, part), begin[lo:hi] - begin[lo], lengths[lo:hi], h[lo:hi])
            first, again, member = _classes(k1, k2, d)
            again |= np.bincount(member, several, len(first)) > 0
            masks, later = np.zeros(len(first), U), np.zeros(len(first), U)
            by = np.lexsort((d[first], h[first]))  # distinct contexts by minimizer, then by doc
            edges = np.flatnonzero(np.r_[True, h[first][by][1:] != h[first][by][:-1], True])
            needed = np.repeat((np.diff(edges) > 1) | (np.add.reduceat(again[by].astype(int), edges[:-1]) > 0), np.diff(edges))
            x = by[needed]
            if len(x):
                masks[x], later[x] = scheme.resolve(content, begin[first[x]], lengths[first[x]], np.stack([h[first[x]].view(np.int64), d[first[x]]]), again[x], scheme.length)
            own = np.where(d > d[first][member], later[member], masks[member])
            told = np.flatnonzero((own != 0) | (several & (later[member] != 0)))
            for i in np.unique(g[told]):
                x = told[g[told] == i]
                back(int(i), "cover", _join(np.stack([k1[x], k2[x]]).tobytes(), *map(_planes, (d[x].view(U), own[x], later[member[x]]))))
        return _table(gs, kinds, out)

    return resolve


def covered(group: _Group) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows lo..hi at a time: their symbols, the symbols before each row, and which symbols are covered."""
    scheme = group.scheme
    hot = group.hashes("hot")
    # Keys of contexts, the group's smallest doc that holds each, and the masks of this and of its other documents.
    told = [_split(p) for p in group.payloads("cover")]
    told = [np.concatenate([np.frombuffer(keys, U).reshape(2, -1), [_from_planes(x, U) for x in rest]]) for keys, *rest in told]
    told = np.concatenate(told, axis=1) if told else np.empty((5, 0), U)
    k1, k2, least, own, others = told[:, np.lexsort((told[1], told[0]))]
    same = np.flatnonzero(np.r_[True, k1[1:] != k1[:-1], True])
    most = int(np.diff(same).max()) if len(k1) else 0

    for lo, hi, symbols, values, before, starts, lengths, rows, h in group.parts():
        begins = np.empty(0, np.int64)
        if len(k1) and len(starts):
            starts, lengths, rows, h = _cooled(scheme, hot, values, starts, lengths, rows, h)
            a, b = _keys(scheme, values, starts, lengths, h)
            at, mask = np.searchsorted(k1, a), np.zeros(len(a), U)
            for _ in range(most):  # keys that share their first 64 bits stand side by side
                at = np.minimum(at, len(k1) - 1)
                hit = (k1[at] == a) & (k2[at] == b)
                mask = np.where(hit, np.where(group.ids[rows].view(U) == least[at], own[at], others[at]), mask)
                at = at + 1
            some = np.flatnonzero(mask)
            bit = ranges(np.zeros(len(some), np.int64), lengths[some])
            on = (np.repeat(mask[some], lengths[some]) >> bit.astype(U)) & U(1) == 1
            begins = (np.repeat(starts[some], lengths[some]) + bit)[on]
        step = np.zeros(len(values) + 1, np.int64)
        np.add.at(step, begins, 1)
        np.add.at(step, begins + scheme.length, -1)
        cut = np.cumsum(step[:-1]) > 0
        for r in np.flatnonzero(group.copy[lo:hi]):
            if before[r + 1] - before[r] >= scheme.length:
                cut[before[r] : before[r + 1]] = True
        yield lo, hi, symbols, before, cut


def cut_repeats(docs: DataFrame, scheme: Scheme, finish: Callable[[_Group], pa.Table], schema: str) -> DataFrame:
    """Run the four steps on (doc_id long, text string); ``finish`` makes the rows of a group."""
    groups = group_count(docs)
    buckets = group_count(docs, 16 << 20)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    digest = dealt.where("doc_id is not null and text is not null").select("g", "doc_id", "mark", F.sha2("text", 256).alias("digest"))
    least = digest.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    least = materialize(least, "copied-texts")  # read back, so that the join below is one whose hot digests Spark can split
    copies = digest.join(least, "digest").where("doc_id > least").select("g", "doc_id", "mark").mapInArrow(_as_control, _CONTROL)

    def together(told: DataFrame, f, schema: str) -> DataFrame:
        return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(f, schema)

    sent = together(copies, _minimizers(scheme, buckets), _ROUTED)
    warm = sent.groupBy("bucket").applyInArrow(_repeated(scheme.hot), _CONTROL)
    routed = together(copies.unionByName(warm), _contexts(scheme, buckets), _ROUTED)
    told = routed.groupBy("bucket").applyInArrow(_shard(scheme), _CONTROL)
    return together(told, lambda d, t: finish(_Group(scheme, d, t)) if d.num_rows else pa.Table.from_batches([], schema=_arrow(schema)), schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().rsplit(" ", 1) for x in schema.split(","))])
