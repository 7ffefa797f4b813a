"""Words and rolling word hashes of whole Arrow batches, in numpy.

Texts are taken as UTF-8 bytes. Two word rules are in use:

- ``SPACED``: maximal runs of anything but space, tab, newline, vertical tab, form feed, carriage return.
- ``ALNUM``: A-Z lower-cased, then maximal runs of 0-9, a-z and non-ASCII characters.

Both are decided byte by byte, because UTF-8 never uses ASCII bytes inside other characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: bytes.translate table: A-Z to a-z, everything that ends an ALNUM word to a space.
ALNUM_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
#: bytes.translate table: A-Z to a-z.
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_space] = 0


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null gives none."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list[bytes], most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `most` bytes together, with the index of the first, so that scratch arrays stay small."""
    begin, total = 0, 0
    for i, x in enumerate(texts):
        if total and total + len(x) > most:
            yield begin, texts[begin:i]
            begin, total = i, 0
        total += len(x)
    if begin < len(texts):
        yield begin, texts[begin:]


def _edges(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, start of each SPACED word, its end, number of words before each text and in all)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=firsts[1:])
    inside = ~_space[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(buf) and inside[0]:
        edge = np.concatenate([[0], edge])
    return buf, edge[0::2], edge[1::2], np.searchsorted(edge[0::2], firsts)


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(SPACED words of the texts in order, number of words before each text; one more entry than texts)."""
    buf, starts, ends, first = _edges(texts)
    return binary_array(ends - starts, buf[~_space[buf]].tobytes()), first


def binary_array(sizes: np.ndarray, data: bytes) -> pa.Array:
    """The runs of `data` of the given sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every SPACED word of the texts in order, number of words before each text; one more entry than texts).

    For ALNUM words give texts that have been through ALNUM_TABLE.
    """
    buf, starts, ends, first = _edges(texts)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    longest = int((ends - starts).max())
    power = np.ones(longest + 1, np.uint64)
    with np.errstate(over="ignore"):
        power[1:] = np.multiply.accumulate(np.full(longest, _BASE, np.uint64))
        span = np.diff(np.append(starts, len(buf)))
        place = np.arange(starts[0], len(buf)) - np.repeat(starts, span)
        np.minimum(place, longest, out=place)
        value = _BYTE[buf[starts[0] :]] * power[place]
        h = np.add.reduceat(value, starts - starts[0])
        h = mix(h + (ends - starts).astype(np.uint64))
    return h, first


def segment_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes of `data`; runs start at `at` and none is empty. Places count modulo 4096."""
    size = np.diff(at, append=len(data))
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(4095, _BASE, np.uint64)]))
        place = (np.arange(len(data)) - np.repeat(at, size)) & 4095
        return mix(np.add.reduceat((_BYTE[data] + np.uint64(1)) * power[place], at) + size.astype(np.uint64))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, at the index of its first; windows may span texts, callers drop those."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = h[:n] * _STEP[0]
        for j in range(1, k):
            total += h[j : j + n] * _STEP[j]
        return mix(total)


def windows_inside(first: np.ndarray, k: int, n_windows: int) -> np.ndarray:
    """For window_hashes(): which of them lie within one text. `first` as word_hashes() gives it."""
    ok = np.ones(max(n_windows, 0), bool)
    if n_windows > 0:
        for j in range(1, k):
            cut = first[1:-1] - j
            cut = cut[(cut >= 0) & (cut < n_windows)]
            ok[cut] = False
    return ok


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text.

    A text of fewer than k words, but not none, has one shingle: all its words. A text without words has none.
    """
    for _, part in pieces(texts):
        h, first = word_hashes(part)
        rolled = window_hashes(h, k)
        for i in range(len(part)):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                yield short_shingle(h[a:b])
            else:
                yield np.zeros(0, np.uint64)


def short_shingle(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = (words * _STEP[: len(words)]).sum(dtype=np.uint64)
        return mix(np.array([total + np.uint64(len(words)) * _STEP[63]], np.uint64))
