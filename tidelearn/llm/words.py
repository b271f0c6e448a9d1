"""Words and word windows of Arrow text columns, found with numpy over UTF-8 bytes.

All helpers work on a run of whole documents at a time (``chunks``), so memory
follows ``CHUNK`` bytes or the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from tidelearn.llm.memory import once

#: Bytes of text worked on at a time; a longer text makes a run of its own.
CHUNK = 4 << 20
#: Bytes hashed at a time within a run.
BLOCK = 1 << 18
#: Words of at least so many bytes are hashed one by one: a polynomial modulo 2^64 cannot tell some long patterns apart.
LONG = 32

_RANDOM = np.random.default_rng(20240229)
_ODD = (_RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BASE, _COUNT = _ODD[0], _ODD[1]
_PLACE = _ODD[2:]
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64)

#: Bytes that part words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Byte values, with and without A-Z made lower case.
EXACT = _BYTES
LOWER = _BYTES.copy()
LOWER[65:91] = _BYTES[97:123]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts (and the last ends); null counts as empty."""
    return bytes_of(column.cast(pa.large_string()).fill_null(""))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column without nulls and where each value starts (and the last ends)."""
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: (index of the first, bytes, bounds from 0)."""
    data, bounds = utf8(column)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans(data: np.ndarray, bounds: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each text's first word (with the total last)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    part = parts[data]
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, part[:-1]
    edge[bounds[bounds < n]] = True
    starts = np.flatnonzero(~part & edge)
    edge[-1], edge[:-1] = True, part[1:]
    edge[bounds[bounds > 0] - 1] = True
    ends = np.flatnonzero(~part & edge) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    powers: list[np.ndarray] = once("powers", list)
    if not powers or len(powers[0]) < n:
        up = np.full(max(n, BLOCK + 4096), _BASE, np.uint64)
        down = np.full(len(up), _INVERSE, np.uint64)
        up[0] = down[0] = 1
        powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return powers[0], powers[1]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    """A 64-bit hash of each span (polynomial over byte values, then mixed; long spans by a library hash)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        length = int(ends[j - 1]) - base
        up, down = _power(length + 1)
        prefix = np.zeros(length + 1, np.uint64)
        np.cumsum(table[data[base : base + length]] * up[:length], out=prefix[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64) * _COUNT
        i = j
    out = mix(out)
    lower = table is LOWER
    for k in np.flatnonzero(ends - starts >= LONG).tolist():
        word = data[starts[k] : ends[k]].tobytes()
        out[k] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return out


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    last = len(h) - width + 1
    total = h[:last] * _PLACE[0]
    for k in range(1, width):
        total += h[k : k + last] * _PLACE[k]
    return mix(total)


def short(h: np.ndarray) -> np.ndarray:
    """One hash for a sequence of fewer words than a window has."""
    return mix((h * _PLACE[: len(h)]).sum(keepdims=True) + np.array([len(h)], np.uint64) * _COUNT)


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(h) < 2:
        return h
    h = np.sort(h)
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int, table: np.ndarray = LOWER) -> Iterator[np.ndarray]:
    """Each text's sorted distinct word windows; the whole sequence as one where it has fewer words; empty without words."""
    starts, ends, first = spans(data, bounds)
    h = hashes(data, starts, ends, table)
    w = windows(h, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield distinct(w[a : b - width + 1])
        else:
            yield short(h[a:b]) if b > a else h[:0]


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flagged bytes each text has."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), bounds))
