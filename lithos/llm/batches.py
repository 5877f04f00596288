"""Arrow batches of texts, and word shingles hashed a whole batch at a time.

All boundaries and hashes come from a few passes of numpy over the batch's
bytes; no Python object is made for a word.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 1 << 20

_K, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Spans of more bytes are hashed one by one.
LONG = 64
#: What of eight loaded bytes belongs to a span with so many bytes left.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE_WORD = np.ones(256, bool)
_SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False


def trim() -> None:
    """Gives freed memory back to the system; a worker that waits for its next task should not hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about ``limit`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _offsets(batch.column(column))[1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else ends[0] * 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def _offsets(array: pa.Array) -> np.ndarray:
    """Offsets of a string or binary array from 0, nulls as empty."""
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    raw = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return raw - raw[0]


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and their offsets; nulls are empty."""
    if array.null_count:
        array = array.fill_null("")
    array = pa.concat_arrays([array])  # from offset 0
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = _offsets(array)
    data = array.buffers()[2]
    first = np.frombuffer(array.buffers()[1], np.int64 if pa.types.is_large_string(array.type) else np.int32)[array.offset]
    return (np.frombuffer(data, np.uint8)[int(first) : int(first + off[-1])] if data is not None else np.zeros(0, np.uint8)), off


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def loads(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number; ``padded`` has eight bytes more than places."""
    return np.ndarray((len(padded) - 8,), "<u8", padded, 0, (1,))


def padded(data: np.ndarray, fold: bool) -> np.ndarray:
    """A copy with eight zero bytes behind it, A-Z lower-cased if ``fold``."""
    out = np.zeros(len(data) + 8, np.uint8)
    out[:-8] = _LOWER[data] if fold else data
    return out


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of padded bytes, eight bytes at a time.

    Every step is a bijection of what it adds, and none is linear, so no family
    of texts collides as it would under a polynomial.
    """
    eight = loads(data)
    h = mix((eight[start] & FIRST[np.minimum(size, 8)]) ^ (size.astype(U64) * U64(_K)))
    more, t = np.flatnonzero(size > 8), 8
    while len(more) and t < LONG:
        h[more] = mix(h[more] ^ (eight[start[more] + t] & FIRST[np.minimum(size[more] - t, 8)]))
        t += 8
        more = more[size[more] > t]
    for i in more.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = _SPACE_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts."""
    n = len(data)
    inside = is_word[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    edge = off[(off > 0) & (off < n)]
    before[edge] = False
    after[edge - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def word_hashes(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = _SPACE_WORD, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text with A-Z lower-cased (``fold``), and each text's offsets among them."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    start, end = spans(data, off, is_word)
    return span_hashes(padded(data, fold), start, end - start), np.searchsorted(start, off).astype(np.int64)


def shingles(array: pa.Array, k: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each text, and each text's offsets among them.

    A text of fewer words has its whole sequence as one shingle; one without
    words or null has none. Repeated shingles stay.
    """
    words, woff = word_hashes(*text_bytes(array), fold=fold)
    count = np.diff(woff)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - k + 1)
        h = np.zeros(n, U64)
        for j in range(k):
            h += words[j : j + n] * U64(pow(_Q, k - 1 - j, 1 << 64))
        keep = np.ones(n, bool)
        # a run may not reach into the next text
        tail = woff[1:-1][:, None] - np.arange(1, k)[None, :]
        tail = tail[(tail >= 0) & (tail < n) & (tail >= woff[:-2][:, None])] if len(woff) > 2 else tail.ravel()[:0]
        keep[tail] = False
        h = mix(h[keep])
    out = np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    soff = np.r_[0, np.cumsum(out)]
    if len(short):
        with np.errstate(over="ignore"):
            own = []
            for i in short:
                value = U64(count[i])
                for w in words[woff[i] : woff[i + 1]]:
                    value = value * U64(_Q) + w
                own.append(value)
            h = np.insert(h, soff[short], mix(np.array(own, U64)))
        out[short] = 1
        soff = np.r_[0, np.cumsum(out)]
    return h, soff


def distinct(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles sorted and without repeats, in the same layout."""
    h = h.copy()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        h[a:b].sort()
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    first[off[:-1][off[:-1] < len(h)]] = True
    return h[first], np.r_[0, np.cumsum(first)][off]
