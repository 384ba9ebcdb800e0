"""Substring dedup on words: suffix automata of reference shards, documents streamed for matching statistics.

The reference of a document is every document with a smaller id, which has no size bound,
so no automaton of the whole corpus is broadcast: ``passages`` deals the passages that
repeat into shards by minimizer, and each shard's automaton meets only the passages that
can match it. Within a shard, contexts are streamed in the order of doc_id: each is first
run through the automaton of all earlier documents (its matching statistics: the longest
suffix of what was read that occurs there), then added to it. A position whose match
reaches the window's length ends a covered window; overlapping windows join to maximal spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .passages import Scheme, _arrow, _Group, covered, cut_repeats
from .symbols import U


class SuffixAutomaton:
    """Online generalized suffix automaton over hashable symbols."""

    __slots__ = ("goto", "length", "link")

    def __init__(self) -> None:
        self.goto: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence) -> None:
        """Insert every substring of ``sequence``."""
        goto, link, length = self.goto, self.link, self.length
        last = 0
        for c in sequence:
            q = goto[last].get(c)
            if q is not None:  # the string is there already
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, c, q)
                continue
            new = len(goto)
            goto.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in goto[p]:
                goto[p][c] = new
                p = link[p]
            if p >= 0:
                q = goto[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c, q: int) -> int:
        goto, link, length = self.goto, self.link, self.length
        copy = len(goto)
        goto.append(dict(goto[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and goto[p].get(c) == q:
            goto[p][c] = copy
            p = link[p]
        return copy

    def statistics(self, sequence) -> list[int]:
        """For each position, the length of the longest match that ends there."""
        goto, link, length = self.goto, self.link, self.length
        state, match, out = 0, 0, []
        for c in sequence:
            while state and c not in goto[state]:
                state = link[state]
                match = length[state]
            nxt = goto[state].get(c)
            if nxt is None:
                match = 0
            else:
                state, match = nxt, match + 1
            out.append(match)
        return out


def _windows(automaton: SuffixAutomaton, sequence: list, length: int) -> int:
    """Mask of the windows of ``length`` symbols that the automaton holds, from the matching statistics of the sequence."""
    mask = 0
    for i, m in enumerate(automaton.statistics(sequence)[length - 1 :]):
        if m >= length:
            mask |= 1 << i
    return mask


def resolve_with_automata(content: np.ndarray, begin: np.ndarray, windows: np.ndarray, by: np.ndarray, again: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of each context's windows that start in an earlier document, and (where ``again``) in its own first or an earlier one.

    Contexts are sorted by (minimizer, doc). Each is streamed through the automaton of all earlier
    documents; once its document is added, those that later documents hold again are streamed once more.
    """
    shard, doc = by
    masks, later = np.zeros(len(begin), U), np.zeros(len(begin), U)
    at = 0
    while at < len(begin):
        automaton = SuffixAutomaton()
        end = at
        while end < len(begin) and shard[end] == shard[at]:
            same = end
            waiting = []
            while same < len(begin) and shard[same] == shard[at] and doc[same] == doc[end]:
                sequence = content[begin[same] : begin[same] + windows[same] + length - 1].tolist()
                if end > at:
                    masks[same] = _windows(automaton, sequence, length)
                waiting.append(sequence)
                same += 1
            if again[end:same].any() or (same < len(begin) and shard[same] == shard[at]):
                for sequence in waiting:
                    automaton.add(sequence)
                for i in np.flatnonzero(again[end:same]):
                    later[end + i] = _windows(automaton, waiting[i], length)
            end = same
        at = end
    return masks, later


_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _finish(with_text: bool):
    schema = _SCHEMA + (", kept_text string" if with_text else "")

    def rows(group: _Group) -> pa.Table:
        n_words, n_removed, digest, texts = [], [], [], []
        for lo, hi, _, before, cut in covered(group):
            base = group.offsets
            for i in range(hi - lo):
                words = group.buf[base[lo + i] : base[lo + i + 1]].tobytes().split()
                gone = cut[before[i] : before[i + 1]]
                removed = int(gone.sum())
                n_words.append(len(words))
                n_removed.append(removed)
                if removed:
                    words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
        columns = [group.docs["doc_id"].combine_chunks(), n_words, n_removed, digest] + ([texts] if with_text else [])
        return pa.Table.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, _arrow(schema), strict=True)], schema=_arrow(schema))

    return rows, schema


def remove_repeated_passages(docs: DataFrame, window: int = 50, with_text: bool = False) -> DataFrame:
    """Cut each word covered by a window of ``window`` words whose sequence also starts in a document with a smaller doc_id.

    ``docs`` has doc_id and text; other columns are ignored whatever their names. Words are
    maximal runs of non-space bytes (space is U+0020 and U+0009 to U+000D). Windows are judged
    on the input, not on what is left.

    Defined cases: a null text has no words; rows with a null doc_id are neither cut nor
    matched; rows with equal doc_id are one document to each other (neither is earlier), each
    gives a row; an empty table gives no rows; texts shorter than a window stay whole.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), and
    kept_text if asked for.
    """
    finish, schema = _finish(with_text)
    return cut_repeats(docs.select("doc_id", "text"), Scheme("word", window, max(1, min(window, (window * 9) // 25)), resolve_with_automata), finish, schema)
