"""Substring dedup on bytes: longest-previous-factor arrays from suffix order.

In each shard of ``passages``, the windows of its contexts are put in suffix order, with
longest common prefixes between neighbours. Previous and next smaller values (of doc_id)
in that order give the nearest suffixes of earlier documents, and the smaller gap of each
side's common prefixes the longest previous factor. A factor of the window's length means
that the window also starts in an earlier document: the later copy goes, the first stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .passages import Scheme, _arrow, _Group, covered, cut_repeats
from .symbols import U, ranges


def suffix_order(content: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``length`` bytes (ties by place), and each one's common prefix with the one before, up to ``length``."""
    padded = np.zeros((len(starts), length + length % 2), np.uint8)
    padded[:, :length] = np.lib.stride_tricks.sliding_window_view(content, length)[starts]
    keys = padded.view(">u2").astype(np.uint16)  # two bytes a key, which numpy sorts by radix
    order = np.lexsort(keys.T[::-1])
    padded = padded[order]
    lcp = np.zeros(len(starts), np.int64)
    for lo in range(1, len(starts), 1 << 16):
        differ = padded[lo : lo + (1 << 16)] != padded[lo - 1 : lo - 1 + len(padded[lo : lo + (1 << 16)])]
        lcp[lo : lo + (1 << 16)] = np.where(differ.any(1), differ.argmax(1), length)
    return order, lcp


def previous_smaller(values: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest place before each with a smaller value (-1: none), and the least of ``lcp`` in between, by jumping."""
    at = np.arange(len(values)) - 1
    low = lcp.copy()
    active = np.flatnonzero((at >= 0) & (values[at] >= values))
    while len(active):
        low[active] = np.minimum(low[active], low[at[active]])
        at[active] = at[at[active]]
        active = active[at[active] >= 0]
        active = active[values[at[active]] >= values[active]]
    low[at < 0] = 0
    return at, low


def longest_previous_factor(values: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix, in suffix order, its longest prefix that also starts at a suffix of a smaller value."""
    _, before = previous_smaller(values, lcp)
    _, after = previous_smaller(values[::-1], np.r_[0, lcp[:0:-1]])
    return np.maximum(before, after[::-1])


def resolve_with_lpf(content: np.ndarray, begin: np.ndarray, windows: np.ndarray, by: np.ndarray, again: np.ndarray, length: int, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Masks of each context's windows that start in an earlier document, and (where ``again``) in its own first or an earlier one.

    Contexts are sorted by (minimizer, doc). One that later documents hold again stands in the
    suffix order a second time, as a document right after its first.
    """
    masks = np.zeros((2, len(begin)), U)
    edges = np.flatnonzero(np.r_[True, by[0][1:] != by[0][:-1], True])
    total = np.r_[0, np.cumsum(windows * (1 + again))]
    rank = 2 * np.unique(by[1], return_inverse=True)[1]
    lo = 0
    while lo < len(edges) - 1:
        hi = max(lo + 1, int(np.searchsorted(total[edges], total[edges[lo]] + most, side="right")) - 1)
        x = np.arange(edges[lo], edges[hi])
        x, copy = np.r_[x, x[again[x]]], np.r_[np.zeros(len(x), int), np.ones(int(again[x].sum()), int)]
        bit = ranges(np.zeros(len(x), np.int64), windows[x])
        owner, copy = np.repeat(x, windows[x]), np.repeat(copy, windows[x])
        order, lcp = suffix_order(content, begin[owner] + bit, length)
        on = np.empty(len(order), bool)
        on[order] = longest_previous_factor((rank[owner] + copy)[order], lcp) >= length
        np.bitwise_or.at(masks, (copy[on], owner[on]), U(1) << bit[on].astype(U))
        lo = hi
    return masks[0], masks[1]


_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(with_bytes: bool):
    schema = _SCHEMA + (", kept_bytes binary" if with_bytes else "")

    def rows(group: _Group) -> pa.Table:
        n_bytes, n_removed, n_spans, digest, kept_all = [], [], [], [], []
        for lo, hi, symbols, before, cut in covered(group):
            gone = np.add.reduceat(np.r_[cut, False], before[:-1]) * (np.diff(before) > 0) if hi > lo else []
            for i in range(hi - lo):
                raw = symbols[before[i] : before[i + 1]]
                spans = 0
                if gone[i]:
                    own = cut[before[i] : before[i + 1]]
                    spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
                    raw = raw[~own]
                kept = raw.tobytes()
                n_bytes.append(int(before[i + 1] - before[i]))
                n_removed.append(n_bytes[-1] - len(kept))
                n_spans.append(spans)
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_bytes:
                    kept_all.append(kept)
        columns = [group.docs["doc_id"].combine_chunks(), n_bytes, n_removed, n_spans, digest] + ([kept_all] if with_bytes else [])
        return pa.Table.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, _arrow(schema), strict=True)], schema=_arrow(schema))

    return rows, schema


def remove_repeated_bytes(docs: DataFrame, window: int = 50, with_bytes: bool = False) -> DataFrame:
    """Cut each byte covered by a ``window``-byte string that also starts in a document with a smaller doc_id.

    ``docs`` has doc_id and text; other columns are ignored whatever their names. Matches never
    cross documents; overlaps count; strings are judged on the input, not on what is left. The
    cut may fall inside a character, so what is kept is bytes.

    Defined cases: a null text is empty; rows with a null doc_id are neither cut nor matched;
    rows with equal doc_id are one document to each other (neither is earlier), each gives a
    row; an empty table gives no rows; texts shorter than a window stay whole.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and
    kept_bytes if asked for.
    """
    finish, schema = _finish(with_bytes)
    return cut_repeats(docs.select("doc_id", "text"), Scheme("byte", window, max(1, window // 2), resolve_with_lpf), finish, schema)
