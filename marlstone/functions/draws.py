"""Draws by MD5, many at a time: the first 32 bits of the digests of short texts that end with a replicate and a number."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Texts that are hashed together: what is held of them stays in a core's cache.
_TOGETHER = 1 << 14
#: The longest text of one block of MD5.
_LONGEST = 55
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNED = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def md5_heads(words: list[np.ndarray | None], n: int) -> np.ndarray:
    """The first 32 bits, as hexadecimal digits have them, of the digests of n blocks, given by their 16 words; None is zero.

    The first word of a digest is settled three steps before the last.
    """
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _ADDED[i]
        if words[g] is not None:
            f += words[g]
        turn = _TURNED[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(_START[0])
    return b.byteswap()


def _by_length(low: int, high: int) -> Iterator[tuple[slice, int, np.ndarray]]:
    """(places, digits, the numbers' digits as bytes) of the numbers of [low, high), by the number of their digits."""
    while low < high:
        digits = len(str(low))
        end = min(high, 10**digits)
        numbers = np.arange(low, end)[:, None] // 10 ** np.arange(digits - 1, -1, -1) % 10
        yield slice(low, end), digits, (numbers + ord("0")).astype(np.uint8)
        low = end


@lru_cache(maxsize=64)
def _tails(at: int, reps: tuple[int, int], numbers: tuple[int, int]) -> list[np.ndarray | None]:
    """The words, replicates times numbers, of blocks whose text goes on with `rep|number` at a place; what is before is zero."""
    text = np.zeros((reps[1] - reps[0], numbers[1] - numbers[0], 64), np.uint8)
    for r, rd, rep in _by_length(*reps):
        for i, nd, number in _by_length(*numbers):
            own = text[r.start - reps[0] : r.stop - reps[0], i.start - numbers[0] : i.stop - numbers[0]]
            own[:, :, at : at + rd] = rep[:, None, :]
            own[:, :, at + rd] = ord("|")
            own[:, :, at + rd + 1 : at + rd + 1 + nd] = number[None, :, :]
            own[:, :, at + rd + 1 + nd] = 0x80
            bits = 8 * (at + rd + 1 + nd)
            own[:, :, 56], own[:, :, 57] = bits & 255, bits >> 8
    words = np.ascontiguousarray(np.moveaxis(text.view("<u4"), 2, 0))
    return [w.copy() if w.any() else None for w in words]


def _hashed(parts: list[tuple[np.ndarray, bytes, int, tuple[int, int], tuple[int, int]]]) -> None:
    """Fills each part's numbers of (draws, text before, n, replicates, numbers) with draws below n."""
    tails = [_tails(len(text), reps, numbers) for _, text, _, reps, numbers in parts]
    fronts = [np.frombuffer(text.ljust(64, b"\0"), "<u4") for _, text, _, _, _ in parts]
    sizes = [len(into) * min(into.shape[1] - numbers[0], numbers[1] - numbers[0]) for into, _, _, _, numbers in parts]
    ends = np.cumsum(sizes)
    words: list[np.ndarray | None] = [None] * 16
    for g in range(16):
        if any(tail[g] is not None or front[g] for tail, front in zip(tails, fronts, strict=True)):
            words[g] = np.zeros(ends[-1], np.uint32)
            for tail, front, size, end, part in zip(tails, fronts, sizes, ends, parts, strict=True):
                own = words[g][end - size : end].reshape(len(part[0]), -1)
                if tail[g] is not None:
                    own[...] = tail[g][:, : own.shape[1]]
                own |= front[g]
    heads = md5_heads(words, ends[-1])
    for (into, _, n, _, numbers), size, end in zip(parts, sizes, ends, strict=True):
        wide = size // len(into)
        into[:, numbers[0] : numbers[0] + wide] = heads[end - size : end].reshape(-1, wide) % np.uint32(n)


def _middles(draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = (draws.shape[1] - 1) // 2, draws.shape[1] // 2
    ordered = np.partition(draws, sorted({low, high}), axis=1)
    return ordered[:, low].astype(np.int32), ordered[:, high].astype(np.int32)


def middle_draws(asked: Iterable[tuple[bytes, int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each (text, n, first, last): the two middle ones of n draws below n of the replicates [first, last).

    A draw is the first 32 bits of the MD5 of `<text><replicate>|<number>`, numbers from 0, modulo n.
    """
    waiting: list[np.ndarray] = []
    parts: list[tuple[np.ndarray, bytes, int, tuple[int, int], tuple[int, int]]] = []
    held = 0
    for text, n, first, last in asked:
        draws = np.empty((last - first, n), np.uint32)
        waiting.append(draws)
        fits = len(text) + len(f"{last - 1}|{n - 1}") <= _LONGEST
        for r in range(first, last if not fits else first):
            draws[r - first] = [int.from_bytes(hashlib.md5(text + b"%d|%d" % (r, i)).digest()[:4], "big") % n for i in range(n)]
        wide = max(1, _TOGETHER // (last - first))
        # numbers in steps that don't depend on n, whose texts' ends are used again; a step whose texts end too late is cut
        for i in range(0, n if fits else 0, wide):
            end = i + wide if len(text) + len(f"{last - 1}|{i + wide - 1}") <= _LONGEST else min(i + wide, n)
            parts.append((draws, text, n, (first, last), (i, end)))
            held += (last - first) * min(wide, n - i)
            if held >= _TOGETHER:
                _hashed(parts)
                parts, held = [], 0
        if not parts:
            yield from map(_middles, waiting)
            waiting = []
    if parts:
        _hashed(parts)
    yield from map(_middles, waiting)
