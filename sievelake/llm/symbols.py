"""Vectorised text primitives on whole UTF-8 buffers: words, 64-bit hashes, sliding minima.

All functions work on numpy arrays that hold many documents end to end; nothing crosses
a document's border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _stream(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U) * _ODD + U(seed))


BYTE_VALUE = _stream(256, 7)
_BASE = U(0xD1342543DE82EF95)
_BASE_INV = U(pow(0xD1342543DE82EF95, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(16, int(n - 1).bit_length())
    have = _powers.get(0)
    if have is None or len(have[0]) < size:
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _powers[0] = have = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums for :func:`slice_hash`; one longer than values."""
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice [start, end), its length mixed in."""
    body = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
    return mix64(body + (ends - starts).astype(U) * _ODD)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if column.null_count:  # a null may stand over bytes
        column = pa.compute.fill_null(column, b"")
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together, or one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~_SPACE
#: Bytes of a benchmark word: digits, letters and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes, and the number of words before each row (and after the last)."""
    word = inside[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _digests(body: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit digest (XXH3) of each of the words that lie end to end in ``body``; each distinct word is digested once."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
    known = words.dictionary.to_pylist()
    digests = np.fromiter(map(xxhash.xxh3_64_intdigest, known), U, len(known))
    return digests[np.asarray(words.indices)] if len(known) else np.empty(0, U)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: bool = False, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the number of words before each row (and after the last).

    fold lower-cases A-Z first. Temporaries cover ``most`` bytes at once (or one longer row).
    """
    hashes, counts = [], np.zeros(len(offsets), np.int64)
    for lo, hi in blocks(offsets, most):
        part = buf[offsets[lo] : offsets[hi]]
        starts, ends, before = word_spans(part, offsets[lo : hi + 1] - offsets[lo], inside)
        counts[lo + 1 : hi + 1] = np.diff(before)
        body = part[inside[part]]
        hashes.append(_digests(LOWER[body] if fold else body, ends - starts))
    return (np.concatenate(hashes) if hashes else np.empty(0, U)), np.cumsum(counts)


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on (len - k + 1 of them), by doubling."""
    done, length, power, size = None, 0, values, 1
    n = len(values)
    if n < k:
        return np.empty(0, U)
    while True:
        if k & size:
            if done is None:
                done, length = power, size
            else:  # what is done stands after this power
                m = n - (length + size) + 1
                done = power[:m] * powers(length + 1)[0][length] + done[size : size + m]
                length += size
        if length == k:
            return mix64(done)
        m = len(power) - size
        power = power[:m] * powers(size + 1)[0][size] + power[size : size + m]
        size *= 2


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from each position on (len - w + 1 of them)."""
    size, low = 1, values
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = w - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every slice, end to end."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
