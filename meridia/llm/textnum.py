"""Vectorised text primitives: Arrow string columns as flat byte arrays.

A batch of documents is handled as one uint8 array plus offsets, in runs of about
``RUN_BYTES``, so that scratch memory stays bounded whatever the number or length of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
P = np.uint64(0x9E3779B97F4A7C15 | 1)
#: The bases of two families of hashes.
BASES = (P, np.uint64(0xD6E8FEB86659FD93))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each, at least one row each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans(is_gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document offsets in words) of the maximal runs that are no gap, within documents."""
    n = len(is_gap)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~is_gap
    first = word.copy()
    first[1:] &= is_gap[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= is_gap[1:] | edge[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of [^\\x20\\x09-\\x0D]+."""
    return spans(_SPACE[raw], offsets)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    step = np.uint64(base)
    while done < n:  # out[done:2*done] = out[:done] * base**done
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
        step = step * step
    return out


_POW: list[list[np.ndarray]] = [[powers(b, 1), powers(np.uint64(pow(int(b), -1, 1 << 64)), 1)] for b in BASES]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: sum of byte * base**position modulo 2**64, mixed.

    Spans are ascending; they may end before the next one starts or share starts (prefixes).
    """
    out = np.empty(len(start), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(start, start[a] + RUN_BYTES, side="left")))
            lo, hi = int(start[a]), int(end[a:b].max())
            n = hi - lo + 1
            if len(_POW[family][0]) < n:
                base = BASES[family]
                _POW[family] = [powers(base, n), powers(np.uint64(pow(int(base), -1, 1 << 64)), n)]
            up, down = _POW[family]
            total = np.empty(n, np.uint64)
            total[0] = 0
            np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
            s, e = start[a:b] - lo, end[a:b] - lo
            out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            a = b
    return out


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive hashes (len(h) - k + 1 of them, none if fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, np.uint64)
        for j in range(k):
            acc = acc * P + h[j : j + n]
        return mix(acc)


def inside(doc_words: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows of k words, over all words of all documents, lie in one document."""
    total = int(doc_words[-1])
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    room = np.repeat(doc_words[1:], np.diff(doc_words))[:n]  # end of the document of the first word
    return np.arange(n) + k <= room


def char_starts(raw: np.ndarray) -> np.ndarray:
    """Bytes that begin a code point."""
    return (raw & 0xC0) != 0x80
