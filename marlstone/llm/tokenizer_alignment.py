"""Cross-tokenizer alignment by lockstep vectorised merging.

Two tokenizations of the same bytes are merged at the offsets where tokens of both end. A state vector in numpy holds
a pair of pointers, into the A tokens and the B tokens, for each stretch of all documents of a batch; a step advances the
pointer whose token ends first, or both where they end together, which is a cut. Finished stretches are compacted away.
What lies between cuts is a group, and all its A-B pairs are links.

How many documents hold a pair of ids linked is counted by chunks of documents: a chunk sends each of its pairs once,
with the number of its documents that hold it, and gets back the pair's count in the corpus. So no shuffle grows with
documents times pairs, and a pair that is in every document is one row of each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ._shared import small_side, staged
from ._tokens import _Known, _Ragged, spans
from ._words import pieces, segment_hashes

A_TOKENIZER, B_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are merged at once; longer documents go in several runs of segments.
PIECE_BYTES = 3 << 20
#: A tokens of a stretch with its own pointers; segments longer than KEPT_BYTES aren't kept.
STRETCH, KEPT_BYTES = 256, 128
#: Links that are written out at once, and links of one group from which its repeated ids are counted first.
LINKS, BIG_GROUP = 1 << 20, 1 << 20
#: Different pairs, summed over the documents of a chunk.
CHUNK_PAIRS = 4 << 20
_BAD, _B = np.uint32(0xFFFFFFFF), np.uint32(1 << 16)
_CHUNK = "chunk long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, whole boolean"


class PairEncoder:
    """Both tokenizers, segment by segment.

    A segment starts at a space behind a visible character. No A or B token crosses such a place, so the tokens of a text
    are those of its segments. The ids of a segment stand in one row: A's, then B's with _B added; _BAD alone where the
    bytes of either differ from the segment's.
    """

    def __init__(self, a: str = A_TOKENIZER, b: str = B_TOKENIZER):
        self.a = Tokenizer.from_file(public_tokenizers.path(a))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path(b))
        # byte-level entries: visible Latin-1 characters stand for themselves, the other bytes for 256, 257, ...
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(x): x for x in seen} | {chr(256 + i): x for i, x in enumerate(sorted({*range(256)} - {*seen}))}
        told = [b""] * (2 << 16)  # the bytes of each token, B's ids behind _B
        for word, i in self.a.get_vocab(with_added_tokens=False).items():
            told[i] = bytes(byte_of[c] for c in word) if all(c in byte_of for c in word) else b""
        for i in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(i)
            told[(1 << 16) + i] = bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()
        self.size = np.array([len(x) for x in told])
        self.spelled = _Ragged(np.frombuffer(b"".join(told), np.uint8), self.size)
        self.known = _Known(np.dtype("<u4"))

    def _learned(self, keys: _Ragged, segments: list[bytes]) -> _Ragged:
        """The rows of `segments`, whose bytes are `keys`."""
        texts = [x.decode("utf-8", "replace") for x in segments]
        space = [self.b.piece_to_id("▁")]  # the model adds no space to an empty text
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [x or space for x in self.b.encode([x[1:] for x in texts], num_threads=1)]
        a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        a_size, b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        b_ids += 1 << 16
        good = self._are(a_ids, a_size, keys) & self._are(b_ids, b_size, keys)
        size = a_size + b_size
        at = np.cumsum(size) - size
        rows = np.empty(int(size.sum()), np.uint32)
        rows[spans(at, a_size)], rows[spans(at + a_size, b_size)] = a_ids, b_ids
        made = _Ragged(np.append(rows, _BAD), np.append(size, 1).astype(np.int32))
        return made.take(np.where(good, np.arange(len(segments)), len(segments)))

    def _are(self, ids: np.ndarray, size: np.ndarray, keys: _Ragged) -> np.ndarray:
        """Whether the bytes of each run of ids are those of the key."""
        alike = _sums(self.size[ids], size) == keys.size
        own = np.flatnonzero(alike)
        values = _Ragged(ids, size).take(own).values if len(own) < len(size) else ids
        told, there = self.spelled.take(values).values, (keys.take(own) if len(own) < len(size) else keys).values
        alike[own[np.searchsorted(np.cumsum(keys.size[own]), np.flatnonzero(told != there), side="right")]] = False
        return alike

    def encode(self, texts: list[bytes]) -> tuple[_Ragged, np.ndarray]:
        """(a row of ids for each segment of `texts`, which start with a space; the number of segments of each)."""
        buf = np.frombuffer(b"".join(texts), np.uint8)
        first = np.cumsum([0, *map(len, texts)])[:-1]
        starts = np.zeros(len(buf), bool)
        starts[1:] = ends_segment(buf)[:-1] & (buf[1:] == 0x20)
        starts[first] = True
        at = np.flatnonzero(starts).astype(np.int64)
        edge = np.append(at, len(buf)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edge), pa.py_buffer(buf)]).dictionary_encode()
        distinct = coded.dictionary
        edge = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1, distinct.offset * 4)
        keys = _Ragged(np.frombuffer(distinct.buffers()[2], np.uint8)[edge[0] : edge[-1]], np.diff(edge))
        hashes = segment_hashes(keys.values, keys.at)
        row = self.known.find(keys, hashes)
        n_segments = np.diff(np.searchsorted(at, np.append(first, len(buf))))
        missing, there = np.flatnonzero(row < 0), np.flatnonzero(row >= 0)
        if not len(missing):
            return self.known.ids.take(row).take(coded.indices.to_numpy()), n_segments
        learned = self._learned(keys.take(missing), distinct.take(pa.array(missing)).to_pylist())
        back = np.empty(len(row), np.int64)
        back[np.concatenate([there, missing])] = np.arange(len(row))
        ids = self.known.ids.take(row[there]).plus(learned).take(back)
        short = np.flatnonzero(keys.size[missing] <= KEPT_BYTES)
        self.known.add(keys.take(missing[short]), hashes[missing[short]], learned.take(short))
        return ids.take(coded.indices.to_numpy()), n_segments


def ends_segment(buf: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 text ends a character that is surely no white space: of one byte, or of two from U+00C0."""
    seen = (buf > 0x20) & (buf < 0x7F)
    seen[1:] |= (buf[1:] >= 0x80) & (buf[:-1] >= 0xC3) & (buf[:-1] < 0xE0)
    return seen


@cache
def pair_encoder(a: str = A_TOKENIZER, b: str = B_TOKENIZER) -> PairEncoder:
    return PairEncoder(a, b)


def merge_in_lockstep(a_end: np.ndarray, b_end: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups end: (a flag for each A token, a flag for each B token).

    a_end and b_end are the offsets at which tokens end, ascending. a_first and b_first are the first tokens of
    stretches, which start at the same offset and end together where the next one starts.
    """
    a_cut, b_cut = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    i, j = a_first.copy(), b_first.copy()
    last = np.append(a_first[1:], len(a_end))
    while len(i):
        x, y = a_end[i], b_end[j]
        both = x == y
        a_cut[i[both]] = True
        b_cut[j[both]] = True
        i += x <= y
        j += y <= x
        going = i < last
        if not going.all():
            i, j, last = i[going], j[going], last[going]
    return a_cut, b_cut


@dataclass
class Aligned:
    """Texts with their tokens and groups; the counts stand by text, a_in and b_in (tokens of a group) by group."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    a_in: np.ndarray
    b_in: np.ndarray
    whole: np.ndarray  # whether the tokens' bytes are the text's


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sums of counts[0] values, then of the next counts[1], and so on."""
    total = np.concatenate([[0], np.cumsum(values)])
    edge = np.concatenate([[0], np.cumsum(counts)])
    return total[edge[1:]] - total[edge[:-1]]


def align(texts: list[bytes], words: PairEncoder) -> Aligned:
    """The groups of texts, each of which starts with a space; one that either tokenizer alters has no tokens."""
    rows, n_segments = words.encode(texts)
    bad = np.zeros(len(rows.size), bool)
    bad[np.searchsorted(np.cumsum(rows.size), np.flatnonzero(rows.values == _BAD), side="right")] = True
    whole = _sums(bad, n_segments) == 0
    of = np.repeat(np.arange(len(texts)), n_segments)
    if not whole.all():
        own = np.flatnonzero(whole[of])
        rows, of = rows.take(own), of[own]
        n_segments = np.where(whole, n_segments, 0)
    is_a = rows.values < _B
    segment_a = _sums(is_a, rows.size)
    a, b = rows.values[is_a], rows.values[~is_a]
    n_a = _sums(segment_a, n_segments)
    n_b = _sums(rows.size, n_segments) - n_a
    a_at, b_at = np.cumsum(segment_a) - segment_a, np.cumsum(rows.size - segment_a) - (rows.size - segment_a)
    # stretches start with texts, and at the first segment behind each STRETCH tokens of a text
    turn = (a_at - np.repeat((np.cumsum(n_a) - n_a), n_segments)) // STRETCH
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (turn[1:] != turn[:-1])
    a_cut, b_cut = merge_in_lockstep(np.cumsum(words.size[a]), np.cumsum(words.size[b]), a_at[new], b_at[new])
    n_groups = _sums(a_cut, n_a)
    a_in, b_in = np.diff(np.flatnonzero(a_cut), prepend=-1), np.diff(np.flatnonzero(b_cut), prepend=-1)
    return Aligned(a, b - _B, n_a, n_b, n_groups, a_in, b_in, whole)


@cache
def _numerals() -> pa.Array:
    """Decimal ids followed by , then by | then by ; for the ids under 65,536."""
    return pa.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(1 << 16)])


def groups_text(x: Aligned) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3;` of each text."""
    if not len(x.a):
        return [b""] * len(x.n_a)
    place = np.empty(len(x.a) + len(x.b), np.int32)
    a_before, b_before = np.cumsum(x.a_in), np.cumsum(x.b_in)
    mark = np.zeros(len(x.a), np.int32)
    mark[a_before - 1] = 1
    place[np.arange(len(x.a)) + np.repeat(b_before - x.b_in, x.a_in)] = x.a + (mark << 16)
    mark = np.zeros(len(x.b), np.int32)
    mark[b_before - 1] = 2
    place[np.arange(len(x.b)) + np.repeat(a_before, x.b_in)] = x.b + (mark << 16)
    told = _numerals().take(pa.array(place))
    edge = np.frombuffer(told.buffers()[1], np.int32, len(told) + 1)[np.concatenate([[0], np.cumsum(x.n_a + x.n_b)])]
    data = memoryview(told.buffers()[2])
    return [bytes(data[p:q]) for p, q in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _counted(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, how often each stands there, or the sum of its `times`)."""
    if times is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(times, at) if len(at) else times


def links(x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """(text << 32 | A id << 16 | B id, number of its links) of each different pair of each text, in order."""
    of = np.repeat(np.arange(len(x.n_groups), dtype=np.uint64), x.n_groups)
    a_at, b_at = np.cumsum(x.a_in) - x.a_in, np.cumsum(x.b_in) - x.b_in
    n = x.a_in * x.b_in
    kept, times = [], []
    for g in np.flatnonzero(n > BIG_GROUP).tolist():  # one long group: its different ids, with their numbers
        (a, a_n), (b, b_n) = (np.unique(ids[at[g] : at[g] + size[g]], return_counts=True) for ids, at, size in ((x.a, a_at, x.a_in), (x.b, b_at, x.b_in)))
        step = max(1, LINKS // len(b))
        for i in range(0, len(a), step):
            kept.append(((of[g] << np.uint64(32)) | ((a[i : i + step, None].astype(np.uint64) << np.uint64(16)) | b[None].astype(np.uint64))).ravel())
            times.append((a_n[i : i + step, None] * b_n[None]).ravel())
    usual = np.flatnonzero(n <= BIG_GROUP)
    done = np.concatenate([[0], np.cumsum(n[usual])])
    low = 0
    while low < len(usual):
        high = max(low + 1, int(np.searchsorted(done, done[low] + LINKS, side="right")) - 1)
        g = usual[low:high]
        rep = np.repeat(g, n[g])
        k = np.arange(len(rep)) - np.repeat(done[low:high] - done[low], n[g])
        i, j = np.divmod(k, x.b_in[rep])
        key = (of[rep] << np.uint64(32)) | (x.a[a_at[rep] + i].astype(np.uint64) << np.uint64(16)) | x.b[b_at[rep] + j].astype(np.uint64)
        key, m = _counted(key)
        kept.append(key)
        times.append(m)
        low = high
    if len(kept) == 1:
        return kept[0], times[0]
    return _counted(np.concatenate([np.zeros(0, np.uint64), *kept]), np.concatenate([np.zeros(0, np.int64), *times]))


def _runs(text: bytes) -> list[bytes]:
    """`text` in parts of about PIECE_BYTES, cut where segments start."""
    if len(text) <= PIECE_BYTES:
        return [text]
    buf = np.frombuffer(text, np.uint8)
    starts = np.flatnonzero(ends_segment(buf)[:-1] & (buf[1:] == 0x20)) + 1
    cuts = np.unique(starts[np.minimum(np.searchsorted(starts, np.arange(PIECE_BYTES, len(text), PIECE_BYTES)), len(starts) - 1)]) if len(starts) else []
    return [text[p:q] for p, q in zip([0, *cuts], [*cuts, len(text)], strict=True)]


class _Document:
    """What is known of a text after some of its runs."""

    def __init__(self):
        self.n = np.zeros(4, np.int64)  # A tokens, B tokens, groups, links
        self.hash, self.pairs, self.times, self.whole = hashlib.sha256(), np.zeros(0, np.uint32), np.zeros(0, np.int64), True

    def add(self, n: np.ndarray, told: bytes, pairs: np.ndarray, times: np.ndarray, whole: bool) -> None:
        self.whole &= whole
        if not self.whole:
            self.n[:] = 0
            self.pairs, self.times = self.pairs[:0], self.times[:0]
            return
        if self.n[0]:
            self.hash.update(b";")
            pairs, times = _counted(np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times]))
        self.hash.update(told[:-1])
        self.n += n
        self.pairs, self.times = pairs, times


def _documents(texts: list[bytes], words: PairEncoder) -> Iterator[_Document]:
    """A document of each text, in order; empty texts have no tokens."""
    parts = [(i, run) for i, text in enumerate(texts) if text for run in _runs(b" " + text)]
    done = {}
    for begin, own in pieces([x for _, x in parts], PIECE_BYTES):
        x = align(own, words)
        keys, times = links(x)
        edge = np.searchsorted(keys, np.arange(len(own) + 1, dtype=np.uint64) << np.uint64(32))
        n = np.stack([x.n_a, x.n_b, x.n_groups, _sums(x.a_in * x.b_in, x.n_groups)], axis=1)
        for k, told in enumerate(groups_text(x)):
            pairs = keys[edge[k] : edge[k + 1]].astype(np.uint32)
            done.setdefault(parts[begin + k][0], _Document()).add(n[k], told, pairs, times[edge[k] : edge[k + 1]], bool(x.whole[k]))
    for i in range(len(texts)):
        yield done.pop(i, None) or _Document()


def _aligned(a: str, b: str, chunk_pairs: int):
    """mapInArrow function: (row, doc_id, text) to the documents of chunks, and a row with the pairs of each chunk.

    A document's row has its pairs as numbers among its chunk's, with their links; the chunk's row has pairs, and the
    number of its documents that hold each. A document of very many pairs has several rows, in chunks of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chunk = pair_encoder(a, b), TaskContext.get().partitionId() << 32
        rows, total = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, total, chunk
            pairs, docs = np.unique(np.concatenate([np.zeros(0, np.uint32), *(x[6] for x in rows)]), return_counts=True)
            told = [(chunk, *x[:6], x[8], np.searchsorted(pairs, x[6]).astype("<u4").tobytes(), x[7].tobytes(), x[9]) for x in rows]
            told.append((chunk, None, None, None, None, None, None, None, pairs.astype("<u4").tobytes(), docs.astype("<u4").tobytes(), None))
            rows, total, chunk = [], 0, chunk + 1
            names = [x.split()[0] for x in _CHUNK.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
            return pa.record_batch([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*told, strict=True), _CHUNK.split(", "), strict=True)], names)

        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            for row, doc_id, x in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), _documents(texts, words), strict=True):
                sha = x.hash.hexdigest() if x.n[0] else ""
                for i in range(0, max(1, len(x.pairs)), chunk_pairs):
                    pairs = x.pairs[i : i + chunk_pairs]
                    if rows and total + len(pairs) > chunk_pairs:
                        yield flush()
                    n = x.n.tolist() if i == 0 else [0] * 4  # further rows of a document only have pairs
                    rows.append((row, doc_id, *n, pairs, x.times[i : i + chunk_pairs].astype("<u4"), sha, len(x.pairs) <= chunk_pairs))
                    total += len(pairs)
        if rows:
            yield flush()

    return run


def _forget() -> None:
    """Frees what this Python worker keeps for encoding, before a task of another kind."""
    pair_encoder.cache_clear()
    _numerals.cache_clear()
    pa.default_memory_pool().release_unused()


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of chunks, a row each."""
    _forget()
    for batch in batches:
        for chunk, pairs, docs in zip(batch.column("chunk").to_pylist(), batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
            pairs, docs = np.frombuffer(pairs, "<u4"), np.frombuffer(docs, "<u4")
            for i in range(0, len(pairs), 1 << 16):
                own = slice(i, i + (1 << 16))
                n = len(pairs[own])
                yield pa.record_batch([pa.array(np.full(n, chunk)), pa.array(np.arange(i, i + n, dtype=np.int32)), pa.array(pairs[own].astype(np.int64)), pa.array(docs[own].astype(np.int64))], ["chunk", "at", "pair", "docs"])


def _scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The sums of a chunk's documents over their links, from the counts of the chunk's pairs."""
    _forget()
    n = counts.num_rows
    total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = counts.column("at").to_numpy()
    total[at], best[at] = counts.column("total").to_numpy(), counts.column("best").to_numpy()
    sums = []
    for pairs, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
        own, times = np.frombuffer(pairs, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
        sums.append((int(best[own] @ times), int(total[own] @ times)))
    out = docs.drop_columns(["chunk", "pairs", "times"])
    for k, name in enumerate(("n_best", "count_sum")):
        out = out.append_column(name, pa.array([x[k] for x in sums], pa.int64()))
    return out


_DIGEST = "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"


def align_tokenizers(docs: DataFrame, a: str = A_TOKENIZER, b: str = B_TOKENIZER, chunk_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """How the tokens of two tokenizers match in each text of `docs` (doc_id long, text string).

    A is a byte-level file of tokenizers and sees a space before the text; B is a model of sentencepiece, which adds that
    space. Gives (row, doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): the numbers of tokens,
    of groups between offsets where tokens of both end, and of links, all A-B pairs of a group. A pair's count is the number
    of rows that hold it linked; n_best counts links whose count is the highest of their A id's, ties included, count_sum
    sums counts over links. groups_sha256 is of `a1,a2|b1;a3|b2,b3`.

    A text that is null or empty, or that the tokens' bytes don't give again, has zeros and the digest ''. Rows are
    counted apart, also those that share a doc_id or have none; `row` is a number of each. Other columns are ignored, an
    empty table gives no rows. Long texts are merged in runs; a task holds the different pairs of one text, and of chunks of
    `chunk_pairs`, summed over documents; that number doesn't change results.
    """
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = staged(plain.mapInArrow(_aligned(a, b, chunk_pairs), _CHUNK), "aligned")
    of_chunks = chunks.where("row is null").select("chunk", "pairs", "times").mapInArrow(_pairs_of, "chunk long, at int, pair long, docs long")
    # a pair's rows are one of each chunk that has it, and meet once: the window gives each its total
    counted = of_chunks.withColumn("total", F.sum("docs").over(Window.partitionBy("pair")))
    counted = staged(counted.select("chunk", "at", "total", F.shiftright("pair", 16).alias("a_id")), "aligned-pairs")
    highest = staged(counted.groupBy("a_id").agg(F.max("total").alias("highest")), "aligned-highest")
    # a row of each A id; the vocabulary bounds it
    counts = counted.join(small_side(highest, 24), "a_id").select("chunk", "at", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    found = (
        chunks.where("row is not null")
        .groupBy("chunk")
        .cogroup(counts.groupBy("chunk"))
        .applyInArrow(_scored, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, whole boolean, n_best long, count_sum long")
    )
    found = staged(found, "aligned-scored")
    rest = found.where("not whole").groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in _DIGEST), F.max("groups_sha256").alias("groups_sha256"))
    columns = ["row", "doc_id", *_DIGEST, "groups_sha256"]
    return found.where("whole").select(columns).unionByName(rest.select(columns))


def aligned_groups(docs: DataFrame, a: str = A_TOKENIZER, b: str = B_TOKENIZER) -> DataFrame:
    """(row, doc_id, groups) of `docs`: groups has the ids of each group's A and B tokens as arrays; see align_tokenizers()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pair_encoder(a, b)
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            for begin, own in pieces(texts, PIECE_BYTES):
                full = [i for i, x in enumerate(own) if x]
                groups = [[] for _ in own]
                if full:
                    x = align([b" " + own[i] for i in full], words)
                    for i, told in zip(full, groups_text(x), strict=True):
                        groups[i] = [{k: [int(y) for y in side.split(b",")] for k, side in zip(("a", "b"), g.split(b"|"), strict=True)} for g in told.split(b";")[:-1]]
                kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
                rows = [batch.column(c).slice(begin, len(own)) for c in ("row", "doc_id")]
                yield pa.record_batch([*rows, pa.array(groups, kind)], ["row", "doc_id", "groups"])

    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "row long, doc_id long, groups array<struct<a: array<int>, b: array<int>>>")
