"""Token ids of whole texts from a public tokenizer file, and files in the shared store."""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.fs  # noqa: E402
from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

from ._words import LOWER_TABLE, segment_hashes  # noqa: E402

TOKENIZER = "word_bpe_49k.json"
#: Segments whose ids a Python worker keeps, about 50 bytes a segment.
CACHED_SEGMENTS = 1_000_000
#: Bytes of text that are segmented at once, and segments that the library sees as one text.
PIECE_BYTES, BULK = 3 << 20, 4096

#: Classes of bytes: 0 white space, 1 letters a-z, 2 marks, 3 all else.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[list(b" \t\n\r\x0b\x0c")] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[list(b".,|!?;:*%$&#")] = 2


def spans(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at[0], at[0] + 1, ... of size[0] in number, then those from at[1], and so on."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class _Ragged:
    """Rows of different lengths in one array."""

    def __init__(self, values: np.ndarray, size: np.ndarray):
        self.values, self.size = values, size
        self.at = np.cumsum(size) - size

    def take(self, rows: np.ndarray) -> _Ragged:
        return _Ragged(self.values[spans(self.at[rows], self.size[rows])], self.size[rows])

    def plus(self, more: _Ragged) -> _Ragged:
        return _Ragged(np.concatenate([self.values, more.values]), np.concatenate([self.size, more.size]))


class _Known:
    """Segments with their ids in arrays sorted by hash, about 50 bytes a segment; those unused for longest are dropped."""

    def __init__(self, kind: np.dtype):
        self.hash, self.row, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.keys, self.ids = _Ragged(np.zeros(0, np.uint8), np.zeros(0, np.int32)), _Ragged(np.zeros(0, kind), np.zeros(0, np.int32))
        self.now = 0

    def find(self, keys: _Ragged, hashes: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none; bytes are compared, not only hashes."""
        self.now += 1
        if not len(self.hash):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        row = self.row[place]
        maybe = np.flatnonzero((self.hash[place] == hashes) & (self.keys.size[row] == keys.size))
        found = np.full(len(hashes), -1)
        if len(maybe):
            own = keys.take(maybe)
            same = np.logical_and.reduceat(self.keys.take(row[maybe]).values == own.values, own.at)
            found[maybe[same]] = row[maybe[same]]
            self.used[row[maybe[same]]] = self.now
        return found

    def add(self, keys: _Ragged, hashes: np.ndarray, ids: _Ragged) -> None:
        hashes, first = np.unique(hashes, return_index=True)
        place = np.searchsorted(self.hash, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.hash):
            new = self.hash[np.minimum(place, len(self.hash) - 1)] != hashes  # of two segments with one hash the first stays
        rows = len(self.used) + np.arange(new.sum())
        self.hash, self.row = np.insert(self.hash, place[new], hashes[new]), np.insert(self.row, place[new], rows)
        self.keys, self.ids = self.keys.plus(keys.take(first[new])), self.ids.plus(ids.take(first[new]))
        self.used = np.append(self.used, np.full(len(rows), self.now, np.int32))
        if len(self.used) > CACHED_SEGMENTS:
            stay = np.flatnonzero(self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2])
            number = np.full(len(self.used), -1)
            number[stay] = np.arange(len(stay))
            self.keys, self.ids, self.used = self.keys.take(stay), self.ids.take(stay), self.used[stay]
            left = number[self.row] >= 0
            self.hash, self.row = self.hash[left], number[self.row[left]]


class SegmentEncoder:
    """Encodes texts segment by segment with a tokenizers file whose pieces don't depend on each other.

    In word_bpe_49k.json white space is dropped, letters are lower-cased, and no piece crosses white space or the border
    between an ASCII letter and a mark; so the ids of a text are those of its segments between such places. The distinct
    segments of many texts are encoded in bulk, and those of late are kept. A text that may hold a special token is
    encoded as a whole.
    """

    def __init__(self, name: str = TOKENIZER, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = special_as_text
        self.plain = Tokenizer(self.tokenizer.model)  # the same model, for segments of a-z, which nothing else changes
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.largest = max(vocabulary.values())
        self.kind = np.dtype("<u2" if self.largest < 1 << 16 else "<u4")
        self.ends_word = np.zeros(self.largest + 1, bool)
        self.ends_word[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known = _Known(self.kind)

    def _whole(self, texts: list[bytes]) -> _Ragged:
        parts = [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]
        return _Ragged(np.concatenate([np.zeros(0, self.kind), *parts]), np.array([len(x) for x in parts], np.int32))

    def _learned(self, segments: list[bytes], is_plain: np.ndarray) -> _Ragged:
        """The ids of segments. Those of letters only are one piece each, so many go through the library as one text."""
        plain, letters, other = np.flatnonzero(is_plain).tolist(), [], []
        for i in np.flatnonzero(~is_plain).tolist():
            x = segments[i]
            (other if x.isascii() or not x.decode().isalpha() else letters).append(i)
        done, rows = _Ragged(np.zeros(0, self.kind), np.zeros(0, np.int32)), []
        for numbers, engine in ((plain, self.plain), (letters, self.tokenizer)):
            for i in range(0, len(numbers), BULK):
                part = numbers[i : i + BULK]
                (got,) = engine.encode_batch_fast([b" ".join([segments[j] for j in part]).decode()], add_special_tokens=False)
                ids = np.array(got.ids, self.kind)
                end = np.flatnonzero(self.ends_word[ids]) + 1
                if len(end) != len(part):
                    other += part
                    continue
                done = done.plus(_Ragged(ids, np.diff(end, prepend=0).astype(np.int32)))
                rows += part
        done = done.plus(self._whole([segments[i] for i in other]))
        back = np.empty(len(segments), np.int64)
        back[rows + other] = np.arange(len(segments))
        return done.take(back)

    def _ids_of(self, distinct: pa.BinaryArray) -> _Ragged:
        """The ids of distinct segments, known or learned."""
        edge = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1, distinct.offset * 4)
        keys = _Ragged(np.frombuffer(distinct.buffers()[2], np.uint8)[edge[0] : edge[-1]], np.diff(edge))
        hashes = segment_hashes(keys.values, keys.at)
        row = self.known.find(keys, hashes)
        missing = np.flatnonzero(row < 0)
        if not len(missing):
            return self.known.ids.take(row)
        new = keys.take(missing)
        learned = self._learned(distinct.take(pa.array(missing)).to_pylist(), np.maximum.reduceat(_CLASS[new.values], new.at) == 1)
        there = np.flatnonzero(row >= 0)
        back = np.empty(len(row), np.int64)
        back[np.concatenate([there, missing])] = np.arange(len(row))
        ids = self.known.ids.take(row[there]).plus(learned).take(back)
        self.known.add(new, hashes[missing], learned)
        return ids

    def _encode(self, texts: list[bytes]) -> _Ragged:
        buf = np.frombuffer(b" ".join(texts).translate(LOWER_TABLE) + b" ", np.uint8)
        kind = _CLASS[buf]
        inside = kind != 0
        starts = inside.copy()
        # a segment starts after white space, and where a letter meets a mark: classes 1 and 2 add up to 3
        starts[1:] &= ~inside[:-1] | ((kind[1:] + kind[:-1] == 3) & inside[:-1])
        first = np.flatnonzero(starts)
        if not len(first):
            return _Ragged(np.zeros(0, self.kind), np.zeros(len(texts), np.int64))
        data = buf[inside]
        at = np.append((np.cumsum(inside, dtype=np.int32) - 1)[first], len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        ids = self._ids_of(coded.dictionary).take(coded.indices.to_numpy())
        ends = np.searchsorted(first, np.cumsum([len(x) + 1 for x in texts]))
        return _Ragged(ids.values, np.diff(np.append(0, np.cumsum(ids.size, dtype=np.int64))[ends], prepend=0))

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of UTF-8 texts one after the other, the number of ids of each)."""
        fresh = [i for i, x in enumerate(texts) if not i or x != texts[i - 1]]  # copies that follow one another count once
        own = [texts[i] for i in fresh]
        out = self._encode([b"" if b"<|" in x else x for x in own])
        special = [i for i, x in enumerate(own) if b"<|" in x]
        if special:
            apart = np.arange(len(own))
            apart[special] = len(own) + np.arange(len(special))
            out = out.plus(self._whole([own[i] for i in special])).take(apart)
        if len(fresh) < len(texts):
            out = out.take(np.repeat(np.arange(len(fresh)), np.diff(fresh, append=len(texts))))
        return out.values, out.size.astype(np.int64)


_encoders: dict[tuple, SegmentEncoder] = {}


def encoder(name: str = TOKENIZER, special_as_text: bool = False) -> SegmentEncoder:
    """The encoder of this Python worker, kept between tasks of the same kind only."""
    if (name, special_as_text) not in _encoders:
        _encoders.clear()
        _encoders[name, special_as_text] = SegmentEncoder(name, special_as_text)
    return _encoders[name, special_as_text]


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """encode_all()'s result with the id `end` after each text."""
    lengths = lengths + 1
    out = np.empty(len(ids) + len(lengths), ids.dtype)
    last = np.cumsum(lengths) - 1
    own = np.ones(len(out), bool)
    own[last] = False
    out[own], out[last] = ids, end
    return out, lengths


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI of the shared scratch folder, and the path within it."""
    return pyarrow.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def write_file(path: str, data: bytes) -> None:
    fs, at = store(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as out:
        out.write(data)


def read_file(path: str) -> bytes:
    fs, at = store(path)
    with fs.open_input_file(at) as file:
        return file.read()
