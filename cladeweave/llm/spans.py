"""Columnar text kernels: Arrow string buffers to word spans and 64-bit hashes with numpy.

Every function works on whole texts.  A batch is cut into slices of whole documents so that
temporary arrays stay small whatever the batch size is; only a single document longer than
``SLICE_BYTES`` makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

#: White space of the text contracts: space and 0x09-0x0D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators for words without punctuation: every ASCII byte that is no letter or digit.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_table(fold_case: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if fold_case:
        codes[65:91] += _U(32)
    return mix64(codes * _U(0xD6E8FEB86659FD93) + _U(0x51ED270B))


_TABLES = {fold: _byte_table(fold) for fold in (False, True)}
#: Odd multipliers that make the place of a word in a shingle count.
PLACE = mix64(np.arange(1, 65, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _P), ("down", _P_INV)):
            steps = np.full(size, _U(base), dtype=np.uint64)
            steps[0] = _U(1)
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw[:0], offs - (offs[0] if len(offs) else 0)


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes, or one row."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(buf: np.ndarray, offs: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``buf`` and, for each document, its range of words."""
    n = len(buf)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    word = ~separator[buf]
    first = np.ones(n + 1, dtype=bool)
    first[1:n] = ~word[:-1]
    first[offs] = True
    starts = np.flatnonzero(word & first[:-1])
    last = np.ones(n + 1, dtype=bool)
    last[: n - 1] = ~word[1:]
    inner = offs[(offs > 0)] - 1
    last[inner] = True
    ends = np.flatnonzero(word & last[:n]) + 1
    return starts, ends, np.searchsorted(starts, offs, "left")


def prefix_hash(buf: np.ndarray, fold_case: bool) -> np.ndarray:
    """``c`` with ``c[j] - c[i]`` the positional sum of bytes i..j (wrapping)."""
    up, _ = _power_tables(len(buf) + 1)
    c = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_TABLES[fold_case][buf] * up[: len(buf)], out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, the same wherever a span stands."""
    _, down = _power_tables(len(c))
    return mix64((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes, in order (``len(words) - k + 1`` of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * PLACE[0]
    for j in range(1, k):
        total += words[j : j + n] * PLACE[j]
    return mix64(total)


def whole_hash(words: np.ndarray) -> np.ndarray:
    """One hash for a sequence of fewer words than a shingle has."""
    terms = np.append(words * PLACE[: len(words)], PLACE[63:64] * _U(len(words)))
    return mix64(terms.sum(dtype=np.uint64, keepdims=True))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    steps = np.ones(total, dtype=np.int64)
    steps[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    steps[at] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(steps)
