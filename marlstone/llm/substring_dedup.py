"""Removal of repeated passages by partitioned suffix trees.

Every word position starts a suffix of its document, of which the first `window` words matter. Suffixes are dealt to
groups by the smallest run of k words within those, by hash: k is 2 where that makes groups that fit in memory, else 4, 8
or all `window` words. Equal suffixes meet in one group, and neighbouring ones mostly share their smallest run, so that
a piece of text travels once for about ten suffixes, with all its words. Group sizes come from an exact count over the
corpus in hashed slots; there are as many slots and groups as the corpus needs. Tasks read a written table of the few slots
that are too large or dealt in turn; all others go by their number.

A group sorts its suffixes by their words and takes common-prefix lengths of neighbours: a run of lengths of `window` or
more is an internal node of the suffix tree that deep, a passage that occurs more than once. Suffixes whose fingerprint
occurs once have no such node above them and aren't sorted; equality is always judged on words. All of a node's
occurrences but the first are removed; neighbouring ones overlap, so maximal repeats go as a whole.

A map task passes on only its own first occurrence of each suffix in a chunk of text, so a passage that a third of all
documents share reaches its group once for each chunk.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import partitions_for, scratch_dir, small_side, staged
from ._tokens import read_file, write_file
from ._words import binary_array, mix, pieces, split_words, text_bytes, window_hashes, windows_inside, word_hashes
from .near_dup import grouped

LEVELS = (2, 4, 8)
#: Fewest bits of a slot's number, the most of those that a map task counts in an array, and slots of a mean group's quarter.
SLOT_BITS, ARRAY_BITS, SPREAD = 16, 18, 16
#: Suffixes of one group.
GROUP = 2_000_000
#: Suffixes that are sorted by their words at once; equal ones stay together.
LEAVES = 200_000
#: Bytes of text whose suffixes a map task holds at once.
CHUNK_BYTES = 8 << 20

_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _anchors(h: np.ndarray, k: int, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, slot) of the smallest k words, the first of equal ones, of each window."""
    grams = window_hashes(h, k)
    low, width, span = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), 1, window - k + 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    place = (low & _LOW).astype(np.int64)
    return place, (mix(grams[place] ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(64 - bits)).astype(np.int64)


def _levels(window: int) -> list[int]:
    return [k for k in LEVELS if k < window] + [window]


def _slot_bits(suffixes: int) -> int:
    """Bits of a slot's number, so that a mean slot has a SPREADth of what may stay together."""
    return max(SLOT_BITS, (SPREAD * suffixes // (GROUP // 4)).bit_length())


def _count_slots(window: int, bits: int):
    """mapInArrow function: (level, slot, n) of the suffixes of a task, or of each piece of text where slots are many."""
    levels = _levels(window)[:-1]

    def rows(level: int, slot: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(slot), level, np.int32)), pa.array(slot.astype(np.int64)), pa.array(n.astype(np.int64))], ["level", "slot", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(levels), 1 << bits), np.int64) if bits <= ARRAY_BITS else None
        for batch in batches:
            for _, part in pieces(text_bytes(batch.column("text"))):
                h, first = word_hashes(part)
                n = len(h) - window + 1
                if n > 0:
                    ok = windows_inside(first, window, n)
                    for i, k in enumerate(levels):
                        slot = _anchors(h, k, window, bits)[1][ok]
                        if total is None:
                            yield rows(i, *np.unique(slot, return_counts=True))
                        else:
                            total[i] += np.bincount(slot, minlength=1 << bits)
        for i, own in enumerate([] if total is None else total):
            slot = np.flatnonzero(own)
            yield rows(i, slot, own[slot])

    return run


def _routes(slot: np.ndarray, n: np.ndarray, fits: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots in order, their groups) of those slots of a level that don't go by their number.

    Suffixes of a slot of more than `fits` go on to the next level (-1), the other slots are dealt in turn from the largest.
    """
    order = np.argsort(slot)
    slot, n = slot[order], n[order]
    group = np.full(len(slot), -1, np.int64)
    own = np.flatnonzero(n <= fits)
    group[own[np.argsort(-n[own], kind="stable")]] = np.arange(len(own)) % parts
    return slot, group


def _write_routes(folder: str, fits: int, parts: int):
    """mapInArrow function over (level, slot, n), sorted by level: a written table for each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["level"]):
            level, path = rows.column("level")[0].as_py(), f"{folder}/{uuid.uuid4().hex}.routes"
            write_file(path, np.stack(_routes(rows.column("slot").to_numpy(), rows.column("n").to_numpy(), fits, parts)).tobytes())
            yield pa.record_batch([pa.array([level], pa.int32()), pa.array([path])], ["level", "path"])

    return run


def _routing(texts: DataFrame, window: int) -> tuple[list[str | None], int, int]:
    """(path of each level's table of routes but the last, bits of a slot's number, groups) for `texts` (text).

    A table names the slots that are too large and those of eight times the mean and more, at most an eighth of all.
    """
    spark, levels = texts.sparkSession, _levels(window)[:-1]
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _slot_bits(size // 4)
    counts = staged(texts.mapInArrow(_count_slots(window, bits), "level int, slot long, n long").groupBy("level", "slot").agg(F.sum("n").alias("n")), "repeat-slots")
    total = counts.where("level = 0").agg(F.sum("n")).first()[0] or size // 4
    parts = max(partitions_for(spark), -(-total // GROUP))
    fits = max(GROUP // 8, total // (4 * parts))
    named = counts.where(F.col("n") > min(fits, max(fits // 8, 8 * (total >> bits)))).repartition(len(levels) or 1, "level").sortWithinPartitions("level")
    made = staged(named.mapInArrow(_write_routes(scratch_dir(spark, "repeat-routes"), fits, parts), "level int, path string"), "repeat-paths")
    paths = {row.level: row.path for row in made.collect()}  # a row a level
    return [paths.get(i) for i in range(len(levels))], bits, parts


def _read_routes(path: str | None) -> tuple[np.ndarray, np.ndarray]:
    slot, group = np.frombuffer(read_file(path) if path else b"", np.int64).reshape(2, -1)
    return slot, group


def _group_of(slot: np.ndarray, table: tuple[np.ndarray, np.ndarray], parts: int) -> np.ndarray:
    """The group of each slot; -1 where it goes on to the next level."""
    named, to = table
    group = slot % parts
    if len(named):
        at = np.searchsorted(named, slot).clip(max=len(named) - 1)
        group = np.where(named[at] == slot, to[at], group)
    return group


def _pack(docs: np.ndarray, starts: np.ndarray) -> bytes:
    """Places sorted by document and start, as differences in byte planes, compressed."""
    cut = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    count = np.diff(np.append(cut, len(docs))).astype(np.int32)
    step = np.diff(starts, prepend=0).astype(np.int32)
    step[cut] = starts[cut]
    own = docs[cut]
    gap = np.diff(own, prepend=np.int64(0))
    planes = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in (gap, count, step))
    return np.array([len(cut), len(docs)], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, np.int64, 2)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[16:]), np.uint8)
    cols, at = [], 0
    for rows, kind in ((n, np.int64), (n, np.int32), (m, np.int32)):
        width = np.dtype(kind).itemsize
        cols.append(np.ascontiguousarray(raw[at : at + rows * width].reshape(width, rows).T).reshape(-1).view(kind))
        at += rows * width
    own, count, step = cols
    cut = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    total = np.cumsum(step.astype(np.int64))
    base = np.repeat(total[cut] - step[cut], count)
    return np.repeat(np.cumsum(own), count), (total - base).astype(np.int32)


def _places(part_of: np.ndarray, docs: np.ndarray, starts: np.ndarray, parts: int):
    """(part, packed places) of each part that occurs."""
    order = np.argsort(part_of, kind="stable")
    edge = np.searchsorted(part_of[order], np.arange(parts + 1))
    for p in range(parts):
        pick = order[edge[p] : edge[p + 1]]
        if len(pick):
            yield p, pick, _pack(docs[pick], starts[pick])


def _doc_part(docs: np.ndarray, parts: int) -> np.ndarray:
    return (mix(docs.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


_EXCHANGED = "part int, paths binary, places binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    part, paths, places = zip(*rows, strict=True)
    return pa.record_batch([pa.array(part, pa.int32()), pa.array(paths, pa.binary()), pa.array(places, pa.binary())], ["part", "paths", "places"])


def _alike(codes: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows at `a` and at `b` have the same words."""
    same = np.ones(len(a), bool)
    for j in range(window):
        same &= codes[a + j] == codes[b + j]
    return same


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _planes(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(len(x), 4).T).tobytes() for x in columns)


def _pack_words(words: pa.Array, codes: np.ndarray, windows: np.ndarray) -> bytes:
    """Pieces of text: windows of each, and their words as numbers in a list of the words that occur."""
    own, inside = np.unique(codes, return_inverse=True)
    listed = words.take(pa.array(own))
    offsets = np.frombuffer(listed.buffers()[1], np.int64, len(own) + 1)
    body = _planes(windows, inside.ravel(), np.diff(offsets)) + listed.buffers()[2].to_pybytes()[: offsets[-1]]
    return np.array([len(windows), len(codes), len(own)], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack_words(blob: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(windows of each piece, numbers of the words of all pieces, list of words)."""
    sizes = np.frombuffer(blob[:24], np.int64)
    raw = zstandard.ZstdDecompressor().decompress(blob[24:])
    ends = 4 * np.cumsum(sizes)
    flat = np.frombuffer(raw, np.uint8, ends[-1])
    windows, inside, lengths = (np.ascontiguousarray(x.reshape(4, -1).T).reshape(-1).view(np.int32) for x in np.split(flat, ends[:-1]))
    return windows.astype(np.int64), inside, binary_array(lengths, raw[ends[-1] :])


def _suffixes(window: int, paths: list[str | None], bits: int, parts: int):
    """mapInArrow function: (place, text) to packed suffixes for their groups; places known to be repeats lack words."""
    levels = _levels(window)

    def packed(chunk: list[bytes], ids: np.ndarray, routes: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        words, first = split_words(chunk)
        coded = words.dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        n = len(codes) - window + 1
        pick = np.flatnonzero(windows_inside(first, window, n))
        if not len(pick):
            return
        h = word_hashes(chunk)[0]
        owner = np.searchsorted(first, pick, side="right") - 1
        docs, starts = ids[owner], (pick - first[owner]).astype(np.int32)
        whole = window_hashes(h, window)[pick]
        order = np.argsort(whole, kind="stable")
        same = np.concatenate([[False], whole[order[1:]] == whole[order[:-1]]])
        # of equal suffixes the first in the order of documents stays; one at the very same place is no repeat of it
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))][same]
        later = order[same]
        true = _alike(codes, pick[later], pick[head], window)
        later, head = later[true], head[true]
        gone = np.sort(later[(docs[later] != docs[head]) | (starts[later] != starts[head])])
        rows = [(p, None, blob) for p, _, blob in _places(_doc_part(docs[gone], parts), docs[gone], starts[gone], parts)]
        stays = np.ones(len(pick), bool)
        stays[later] = False
        docs, starts, pick = docs[stays], starts[stays], pick[stays]
        group, anchor = np.full(len(pick), -1, np.int64), np.zeros(len(pick), np.int64)
        for i, k in enumerate(levels):
            todo = np.flatnonzero(group < 0)
            if len(todo):
                place, slot = (x[pick[todo]] for x in _anchors(h, k, window, bits))
                # the last level is as wide as there are groups
                group[todo] = _group_of(slot, routes[i], parts) if i < len(routes) else whole[stays][todo] % np.uint64(parts)
                anchor[todo] = place * len(levels) + i
        cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (pick[1:] != pick[:-1] + 1)]))
        windows = np.diff(np.append(cut, len(pick)))
        for p, mine, blob in _places(group[cut], docs[cut], starts[cut], parts):
            text = codes[_runs(pick[cut[mine]], windows[mine] + window - 1)]
            rows.append((p, _pack_words(words, text, windows[mine]), blob))
        for i in range(0, len(rows), 32):
            yield _batch(rows[i : i + 32])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes = [_read_routes(path) for path in paths]
        for batch in batches:
            ids = batch.column("place").to_numpy()
            by_id = np.argsort(ids, kind="stable")
            raw = text_bytes(batch.column("text"))
            ids, texts = ids[by_id], [raw[i] for i in by_id]
            for at, chunk in pieces(texts, CHUNK_BYTES):
                yield from packed(chunk, ids[at : at + len(chunk)], routes)

    return run


def _deep_nodes(codes: np.ndarray, at: np.ndarray, docs: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, node) of the suffixes at `at`, by their words and then their places; a new node starts where the common
    prefix with the suffix before is shorter than `window` words."""
    table = codes[at[:, None] + np.arange(window)]
    order = np.lexsort((starts, docs, *table.T[::-1]))
    equal = table[order[1:]] == table[order[:-1]]
    common = np.where(equal.all(axis=1), window, equal.argmin(axis=1))
    return order, np.cumsum(np.concatenate([[0], common < window]))


def _repeats(window: int, parts: int):
    """mapInArrow function over one group at a time: the places of all but the first occurrence of each deep node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["part"]):
            windows, inside, words, docs, starts = [], [], [], [], []
            for p, blob in zip(group.column("paths").to_pylist(), group.column("places").to_pylist(), strict=True):
                if p is None:
                    yield _batch([(group.column("part")[0].as_py(), None, blob)])
                    continue
                for out, x in zip((windows, inside, words, docs, starts), (*_unpack_words(p), *_unpack(blob)), strict=True):
                    out.append(x)
            if not words:
                continue
            # equal words have equal numbers in the whole group
            number = pa.concat_arrays(words).dictionary_encode().indices.to_numpy()
            before = np.cumsum([0, *map(len, words)])
            codes = number[np.concatenate([x + b for x, b in zip(inside, before[:-1], strict=True)])]
            windows, docs, starts = (np.concatenate(x) for x in (windows, docs, starts))
            size = windows + window - 1
            at = _runs(np.cumsum(size) - size, windows)
            path = window_hashes(mix(np.arange(1, number.max() + 2, dtype=np.uint64))[codes], window)[at]
            order = np.argsort(path, kind="stable")
            twin = path[order[1:]] == path[order[:-1]]
            several = order[np.concatenate([[False], twin]) | np.concatenate([twin, [False]])]
            if not len(several):
                continue
            piece = np.repeat(np.arange(len(windows)), windows)[several]
            begin = (np.cumsum(windows) - windows)[piece]
            docs, starts = docs[piece], starts[piece] + (several - begin).astype(np.int32)
            path, at = path[several], at[several]
            edge = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            cuts = [*edge[np.unique(np.searchsorted(edge, np.arange(0, len(path), LEAVES)).clip(max=len(edge) - 1))].tolist(), len(path)]
            found = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                order, node = _deep_nodes(codes, at[a:b], docs[a:b], starts[a:b], window)
                d, s = docs[a:b][order], starts[a:b][order]
                head = np.searchsorted(node, node)
                later = (d != d[head]) | (s != s[head])
                found.append((d[later], s[later]))
            d, s = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((s, d))
            d, s = d[order], s[order]
            for q, _, blob in _places(_doc_part(d, parts), d, s, parts):
                yield _batch([(q, None, blob)])

    return run


def _spans_of(window: int):
    """mapInArrow function over the places of a set of documents: (doc_id, from/to word pairs) without overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["part"]):
            places = [_unpack(x) for x in group.column("places").to_pylist()]
            docs, starts = (np.concatenate(x) for x in zip(*places, strict=True))
            order = np.lexsort((starts, docs))
            docs, starts = docs[order], starts[order].astype(np.int64)
            fresh = np.concatenate([[True], (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + window)])
            at = np.flatnonzero(fresh)
            last = np.append(at[1:], len(docs)) - 1
            own, pairs = docs[at], np.stack([starts[at], starts[last] + window], axis=1)
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            blobs = [pairs[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(own)), strict=True)]
            for i in range(0, len(cut), 10_000):
                yield pa.record_batch([pa.array(own[cut[i : i + 10_000]]), pa.array(blobs[i : i + 10_000], pa.binary())], ["gone_id", "spans"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, digest, kept = [], [], [], []
        for text, spans in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            words = text.split()
            total.append(len(words))
            if spans:
                at, left = 0, []
                for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
                    left += words[at:a]
                    at = b
                words = left + words[at:]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
            digest.append(hashlib.sha256(kept[-1]).hexdigest())
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
        )


def _placed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `place`, a number of each document: its doc_id, if no row lacks one or shares it."""
    unclear = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if unclear.isEmpty():
        return docs.withColumn("place", F.col("doc_id"))
    rows = staged(docs.withColumn("row", F.monotonically_increasing_id()), "repeat-rows")
    # rows without an id are told apart by their number, as many may have the same text
    rows = rows.withColumns({"digest": F.xxhash64("text"), "own": F.when(F.col("doc_id").isNull(), F.col("row"))})
    key = ["doc_id", "digest", "own"]
    order = [F.col(c).asc_nulls_last() for c in key]
    dealt = rows.select(*key).distinct().repartitionByRange(partitions_for(docs.sparkSession), *order).sortWithinPartitions(*order)
    # partitions are ranges in turn, so these numbers grow with the key
    places = staged(dealt.withColumn("place", F.monotonically_increasing_id()), "repeat-places")
    p = places.select(*(F.col(c).alias(f"its_{c}") for c in key), "place")
    same = (F.col("digest") == F.col("its_digest")) & F.col("doc_id").eqNullSafe(F.col("its_doc_id")) & F.col("own").eqNullSafe(F.col("its_own"))
    return rows.join(small_side(p, 48), same).select("doc_id", "text", "place")


def drop_repeated_passages(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) of each row of `docs` (doc_id long, text string).

    Words are runs without ASCII white space, compared as they are. Each word goes that is covered by a window of
    `window` words whose sequence also starts earlier: in a document of a smaller doc_id, or earlier in the same.
    Windows are judged on the input. kept_text joins the other words by one space.

    Null, empty and short texts lose nothing; no words give the digest of the empty string. A null doc_id comes
    after all others. Rows without a doc_id, and rows that share one, are documents of their own, in the order of a hash
    of their text; only rows that repeat both doc_id and text are one document, which loses the same words in each.
    Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = _placed(docs)
    paths, bits, parts = _routing(docs.select("text"), window)
    deal = lambda df: df.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    suffixes = deal(docs.select("place", "text").mapInArrow(_suffixes(window, paths, bits, parts), _EXCHANGED))
    places = deal(suffixes.mapInArrow(_repeats(window, parts), _EXCHANGED))
    spans = staged(places.mapInArrow(_spans_of(window), "gone_id long, spans binary"), "repeat-spans")
    joined = docs.join(small_side(spans, 48, F.octet_length("spans")), F.col("place") == F.col("gone_id"), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
