"""Words, shingles and their hashes for whole Arrow batches of texts, in numpy.

Words are the runs of bytes other than ASCII white space, with A-Z lower-cased: on UTF-8 that is the
same as on code points. A batch is worked through in slices of about SLICE bytes (a longer text is a
slice of its own), so memory is bounded by the slice or by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(_U) | _U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE * 2)
        base, inv = np.full(size, _BASE), np.full(size, _INV)
        base[0] = inv[0] = 1
        _powers[:] = [np.cumprod(base), np.cumprod(inv)]
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 of all texts of a string column, null as empty; len(column) + 1 offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about size bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the count at the end) for texts at offsets of raw."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    low = _LOWER[raw]
    space = _SPACE[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a text ends the words of the one before
    is_word = ~space
    start = is_word.copy()
    start[1:] &= space[:-1] | edge[1:n]
    end = is_word
    end[:-1] &= space[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _power(n + 1)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum(_BYTE[low] * power[:n], out=total[1:])
    h = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
    return h, np.searchsorted(s, offsets).astype(np.int64)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, index of its text). A text of fewer words gives its whole sequence as one."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    if len(h) >= k:
        m = len(h) - k + 1
        out = np.zeros(m, _U)
        for j in range(k):
            out += h[j : j + m] * _PLACE[j]
        inside = text[:m] == text[k - 1 :]
        out, owner = mix(out[inside]), text[:m][inside]
    else:
        out, owner = np.zeros(0, _U), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        more = np.array([whole(h[first[i] : first[i + 1]]) for i in short], _U)
        out, owner = np.concatenate([out, more]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def whole(h: np.ndarray) -> np.uint64:
    """The hash of a text's whole sequence of fewer words than a shingle has."""
    return mix(np.sum(h * _PLACE[: len(h)], dtype=_U, keepdims=True) + np.array([len(h)], _U) * _U(0xA0761D6478BD642F))[0]


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, sorted distinct shingle hashes of a slice's texts one after another, offsets by text)."""
    raw, offsets = buffers(column)
    for i, j in slices(offsets):
        h, first = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        sh, owner = shingles(h, first, k)
        cut = np.searchsorted(owner, np.arange(j - i + 1))
        parts = [np.unique(sh[cut[x] : cut[x + 1]]) for x in range(j - i)]
        yield i, np.concatenate(parts) if parts else sh, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
