"""Words of whole Arrow columns at once: byte classes, word bounds and 64-bit word hashes in numpy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Work arrays go back to the system as they are freed, so that reused workers stay as small as their largest slice.
pa.set_memory_pool(pa.system_memory_pool())
_libc = ctypes.CDLL(None)
with contextlib.suppress(AttributeError):
    _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD


def release() -> None:
    """Gives freed memory back to the system."""
    with contextlib.suppress(AttributeError):
        _libc.malloc_trim(0)


#: A-Z folded; word bytes are 0-9, a-z and all of non-ASCII characters.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INV)):
            t = np.full(max(n, 1 << 16), b, dtype=np.uint64)
            t[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(t, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array, max_bytes: int = 400_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about max_bytes of text each, so that work arrays stay small; one long text makes a range of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    start = total = 0
    for i, n in enumerate(size):
        if i > start and total + n > max_bytes:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(size):
        yield start, len(size)
    release()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (and the last ends); null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = texts.buffers()
    bounds = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = (int(bounds[0]), int(bounds[-1])) if len(texts) else (0, 0)
    bytes_ = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    return bytes_, (bounds - lo if len(texts) else np.zeros(1, np.int64))


def words(bytes_: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first): each word's hash and byte range, and the number of words before each text."""
    n = len(bytes_)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(bounds), np.int64)
    is_word = WORD[bytes_]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    finish = is_word.copy()
    finish[:-1] &= ~is_word[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]
    begins[edges] = is_word[edges]
    finish[edges - 1] = is_word[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    up, down = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((FOLD[bytes_].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, starts, ends, np.searchsorted(starts, bounds)


def word_list(text: str | None) -> list[bytes]:
    """The words of one text, folded; for building automata and for checks."""
    b, bounds = raw(pa.array([text], pa.string()))
    _, s, e, _ = words(b, bounds)
    f = FOLD[b].tobytes()
    return [f[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)]
