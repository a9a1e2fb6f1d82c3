"""Words of whole Arrow batches of texts, as numpy arrays.

A batch of texts is one buffer of UTF-8 bytes.  Words are runs of bytes of a class, so their places
and 64-bit hashes come from a few passes over the buffer instead of a loop over words.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: Bytes of words that white space ends.
NOT_SPACE = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words made of ASCII letters, digits and everything beyond ASCII.
ALPHANUMERIC = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random value for each byte.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each (one more than texts); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes as they are."""
    return _LOWER[raw]


@dataclass
class Words:
    """Words in order: first byte, byte after the last, text each belongs to; words of a text are
    ``first[t]:first[t + 1]``."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray


def words_of(raw: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> Words:
    """Words as longest runs of bytes in ``kept``; no word goes over the end of a text."""
    inside = kept[raw]
    before = np.empty_like(inside)
    if len(raw):
        before[0] = False
        before[1:] = inside[:-1]
    begins = inside & ~before
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[cuts] = inside[cuts]
    after = np.zeros(len(raw), bool)
    if len(raw):
        after[:-1] = ~inside[1:]
        after[-1] = True
        after[cuts - 1] = True
    start = np.flatnonzero(begins)
    end = np.flatnonzero(inside & after) + 1
    first = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, end, text, first)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever it stands."""
    return hashes_between(prefix_sums(raw), start, end)


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a polynomial over the bytes, and the inverse powers that move a span to the start."""
    power = _powers(_BASE, len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power, out=sums[1:])
    return sums, _powers(_INVERSE, len(raw) + 1)


def hashes_between(sums, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, back = sums
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


#: Bytes of text in a slice where a text takes a hundred times its bytes for a moment.
SLICE = 250_000
_cache: dict = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What tasks of a worker share until another stage's ``release``."""
    if key not in _cache:
        _cache[key] = make()
    return _cache[key]


def release(but: Hashable = None) -> None:
    """Give memory back to the system, what is kept for ``but`` excepted: later stages use the same workers."""
    for key in _cache.keys() - {but}:
        del _cache[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(rows: Iterator, but: Hashable = None) -> Iterator:
    """The same rows, made by a task that finds no memory of earlier stages and leaves none to later ones.

    Memory is given back after ``rows`` has ended, when nothing of it holds arrays any more.
    """
    release(but)
    yield from rows
    release(but)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    key = int(base)
    if key not in _cache or len(_cache[key]) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, np.uint64)
        if size:
            out[0] = 1
        _cache[key] = np.cumprod(out)
    return _cache[key][:n]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words, from the words' hashes; shorter by ``size - 1``."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= _BASE
        out += words[k : k + n]
    return mix(out + np.uint64(size))


def batches(rows: pa.RecordBatch, column: str, most: int = 2_000_000):
    """Slices of a batch with about ``most`` bytes of text each; a longer text is a slice alone."""
    texts = rows.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield rows.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    if begin < len(sizes):
        yield rows.slice(begin)
