"""Benchmark decontamination by Wu-Manber search for many word sequences at once.

Patterns are windows of benchmark words. For each pattern length there is a shift table over hashed blocks of up to three
words: how far the search may jump when it sees that block at the end of its window. Blocks that may end a pattern have
no shift; the hashes of the block and of the whole window then lead to the bucket of patterns that end so, and their bytes
are compared.

Equal benchmark texts are one entry with the ids of their items beside it. Entries are dealt to blocks of bounded size by a
hash; a text with very many ids is several entries. A task builds each block's tables, as arrays of about 35 bytes a word,
and writes them to the shared scratch folder; searching tasks read the tables of one block. All documents pass one block
after the other, and what a block has found is written before the next is begun: numbers of rows with spans and ids, never
the documents again. Neither texts nor tables pass through the driver.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, partitions_for, scratch_dir, small_side, staged
from ._tokens import read_file, write_file
from ._words import ALNUM_TABLE, text_bytes
from .near_dup import grouped

#: Benchmark text, in bytes, whose tables a task holds at once, and the most that stays together of one item.
BLOCK_BYTES, PART_BYTES = 6 << 20, 1 << 20
#: Ids that one entry has beside its text.
ENTRY_IDS = 4096


def alnum_words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


class PatternTables:
    """Shift and bucket tables of the windows of some texts, by window length, with the item ids of each text."""

    def __init__(self, items: list[list[str]], classes: list[tuple]):
        self.items, self.classes = items, classes

    @classmethod
    def build(cls, texts: list[tuple[list[str], list[bytes]]], window: int) -> PatternTables:
        """From (item ids, words); fewer words than `window` are one pattern."""
        by_size: dict[int, list[tuple[int, list[bytes]]]] = {}
        for number, (_, words) in enumerate(texts):
            if words:
                by_size.setdefault(min(window, len(words)), []).append((number, words))
        classes = []
        for size, own in sorted(by_size.items(), reverse=True):
            block, n = min(3, size), sum(len(words) - size + 1 for _, words in own)
            bits = max(10, (8 * n).bit_length())
            # a shift is a byte; one that is cut to 255 only jumps less far
            shift = np.full(1 << bits, min(255, size - block + 1), np.uint8)
            key, begin, end, item = np.zeros(n, np.uint64), np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
            at = base = 0
            for number, words in own:
                edge = np.cumsum([0, *(len(x) + 1 for x in words)])
                count = len(words) - size + 1
                ends = np.array([crc32(b" ".join(words[i : i + block])) for i in range(len(words) - block + 1)], np.uint32)
                for step in range(size - block + 1):  # a block that ends `step` words before its window's end
                    np.minimum.at(shift, ends[size - block - step : size - block - step + count] & np.uint32((1 << bits) - 1), np.uint8(min(255, step)))
                whole = np.array([crc32(b" ".join(words[i : i + size])) for i in range(count)], np.uint64)
                key[at : at + count] = ends[size - block :].astype(np.uint64) << np.uint64(32) | whole
                begin[at : at + count], end[at : at + count] = base + edge[:count], base + edge[size:] - 1
                item[at : at + count] = number
                at, base = at + count, base + int(edge[-1])
            order = np.argsort(key, kind="stable")
            text = b" ".join(b" ".join(words) for _, words in own)
            classes.append((size, block, shift.tobytes(), array("Q", key[order].tobytes()), *(array("I", x[order].tobytes()) for x in (begin, end, item)), text))
        return cls([ids for ids, _ in texts], classes)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(the spans of words that occur, the ids of the items they are from)."""
        spans, found_in, known = [], set(), set()
        for size, block, shift, key, begin, end, item, text in self.classes:
            mask, n, many, at, join = len(shift) - 1, len(words), len(key), size, b" ".join
            while at <= n:  # the window is words[at - size : at]
                tail = crc32(join(words[at - block : at]))
                step = shift[tail & mask]
                if step:
                    at += step
                    continue
                seen = join(words[at - size : at])
                if seen not in known:  # the texts of a window are walked once a document
                    wanted = tail << 32 | crc32(seen)
                    i = bisect_left(key, wanted)
                    while i < many and key[i] == wanted:
                        if text[begin[i] : end[i]] == seen:
                            known.add(seen)
                            found_in.add(item[i])
                        i += 1
                if seen in known:
                    spans.append((at - size, at))
                at += 1
            known.clear()
        return spans, {x for number in found_in for x in self.items[number]}

    def to_bytes(self) -> bytes:
        ids = json.dumps(self.items).encode()
        out = [struct.pack("<qq", len(ids), len(self.classes)), ids]
        for size, block, *rest in self.classes:
            blobs = [x if isinstance(x, bytes) else x.tobytes() for x in rest]
            out += [struct.pack("<qq6q", size, block, *map(len, blobs)), *blobs]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> PatternTables:
        n, many = struct.unpack_from("<qq", data)
        at, items, classes = 16 + n, json.loads(data[16 : 16 + n]), []
        for _ in range(many):
            size, block, *lengths = struct.unpack_from("<qq6q", data, at)
            at += 64
            blobs = []
            for x in lengths:
                blobs.append(data[at : at + x])
                at += x
            shift, key, begin, end, item, text = blobs
            classes.append((size, block, shift, array("Q", key), array("I", begin), array("I", end), array("I", item), text))
        return cls(items, classes)


def _parted(window: int):
    """mapInArrow function: (item_id, text) to its normal words, long items in parts that share `window` - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                words = alnum_words(text)
                if len(text) <= PART_BYTES:
                    rows.append((item, b" ".join(words)))
                    continue
                begin = 0
                while begin + window <= len(words) or begin == 0:
                    size, stop = 0, begin
                    while stop < len(words) and (size < PART_BYTES or stop < begin + window):
                        size, stop = size + len(words[stop]) + 1, stop + 1
                    rows.append((item, b" ".join(words[begin:stop])))
                    begin = stop - window + 1 if stop < len(words) else len(words)
            items, texts = zip(*rows, strict=True) if rows else ((), ())
            yield pa.record_batch([pa.array(items, pa.string()), pa.array(texts, pa.binary())], ["item_id", "words"])

    return run


def _build(folder: str, window: int):
    """mapInArrow function over (block, ids, words), sorted by block: a written table for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["block"]):
            texts = [(i, w.split()) for i, w in zip(group.column("ids").to_pylist(), group.column("words").to_pylist(), strict=True)]
            path = f"{folder}/{group.column('block')[0].as_py():06d}-{uuid.uuid4().hex[:8]}.wum"
            write_file(path, PatternTables.build(texts, window).to_bytes())
            yield pa.record_batch([pa.array([path])], ["path"])

    return run


def _entries(parts: DataFrame) -> DataFrame:
    """(words, ids) of each distinct text of `parts` (item_id, words); one with more than ENTRY_IDS rows is several entries."""
    digest = F.xxhash64("words")  # texts that share one may be split for nothing, and that is all
    many = staged(parts.groupBy(digest.alias("digest")).agg(F.count("*").alias("n")).where(F.col("n") > ENTRY_IDS), "benchmark-copies")
    share = F.pmod(F.xxhash64("item_id"), F.ceil(F.coalesce("n", F.lit(1)) / ENTRY_IDS))
    dealt = parts.join(small_side(many, 24), digest == F.col("digest"), "left").select("words", "item_id", share.alias("share"))
    return dealt.distinct().groupBy("words", "share").agg(F.array_sort(F.collect_list("item_id")).alias("ids")).select("words", "share", "ids")


def pattern_tables(benchmark: DataFrame, window: int) -> list[str]:
    """Builds the tables of `benchmark` (item_id, text), block by block, in the shared scratch folder; their paths."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    parts = staged(rows.mapInArrow(_parted(window), "item_id string, words binary"), "benchmark-parts").where("octet_length(words) > 0")
    entries = staged(_entries(parts), "benchmark-entries")
    size = F.octet_length("words") + F.coalesce(F.octet_length(F.array_join("ids", ",")), F.lit(0))
    total = entries.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("words", "share"), F.lit(blocks)).cast("int")
    dealt = entries.select(block.alias("block"), "ids", "words").repartition(min(blocks, partitions_for(spark)), "block").sortWithinPartitions("block")
    made = staged(dealt.mapInArrow(_build(scratch_dir(spark, "benchmark-tables"), window), "path string"), "benchmark-paths")
    return [row.path for row in made.sort("path").toLocalIterator()]


_open: dict[str, PatternTables] = {}


def _tables(path: str) -> PatternTables:
    """The tables at `path`, kept in a Python worker until it needs others."""
    if path not in _open:
        _open.clear()
        _open[path] = PatternTables.from_bytes(read_file(path))
    return _open[path]


_VERDICT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words in spans that neither touch nor overlap."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _verdicts(docs: pa.Array, found: Iterator[tuple[int, list, set]]) -> pa.RecordBatch:
    """The result of documents from (words, spans, item ids) of each."""
    rows = []
    for n, spans, items in found:
        hit, ids = sum(b - a for a, b in _merged(spans)), sorted(items)
        rows.append((n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.record_batch([docs, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _judge(path: str | None):
    """mapInArrow function: the result of each document from the only block, or from none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _tables(path).search if path else lambda words: ([], set())
        for batch in batches:
            words = map(alnum_words, text_bytes(batch.column("text")))
            yield _verdicts(batch.column("doc_id"), ((len(w), *search(w)) for w in words))

    return run


_FOUND = "row long, doc_id long, n_words long, spans array<long>, items array<string>"


def _search(path: str, every: bool):
    """mapInArrow function: what one block finds in each row, as ends of spans and ids; rows without finds only if `every`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _tables(path).search
        for batch in batches:
            rows = []
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                words = alnum_words(text)
                spans, items = search(words)
                if spans or every:
                    rows.append((row, doc, len(words), [x for pair in _merged(spans) for x in pair], sorted(items)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["row", "doc_id", "n_words", "spans", "items"])

    return run


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: the result of each document from all blocks' finds."""
    for batch in batches:
        finds = zip(*(batch.column(c).to_pylist() for c in ("n_words", "spans", "items")), strict=True)
        yield _verdicts(batch.column("doc_id"), ((n, [x for own in spans for x in zip(own[::2], own[1::2], strict=True)], {x for own in items for x in own}) for n, spans, items in finds))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of `docs` (doc_id long, text string).

    Words are lower-cased (A-Z) runs of digits, letters a-z and non-ASCII characters. A benchmark item (item_id, text)
    occurs where `window` consecutive words of it, or all of them if there are fewer, stand in a document; n_hit
    counts the document's words inside occurrences, n_items the items that occur.

    Null and empty texts have no words, so nothing is hit and no item of that kind occurs. Items that share an item_id
    count once, those without one are searched for but not counted. Repeated documents give repeated rows, a null
    doc_id stays null, an empty benchmark contaminates nothing, other columns are ignored.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    paths = pattern_tables(benchmark, window)
    if len(paths) <= 1:
        return out.mapInArrow(_judge(paths[0] if paths else None), _VERDICT)
    rows = staged(out.withColumn("row", F.monotonically_increasing_id()), "benchmark-rows")
    found = [staged(rows.mapInArrow(_search(path, not i), _FOUND), "benchmark-found") for i, path in enumerate(paths)]
    each = reduce(DataFrame.unionByName, found).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")
    )
    return each.drop("row").mapInArrow(_combine, _VERDICT)


def _clean(path: str):
    """mapInArrow function: the rows in which the only block finds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _tables(path).search
        for batch in batches:
            yield batch.filter(pa.array([not search(alnum_words(x))[0] for x in text_bytes(batch.column("text"))], pa.bool_()))

    return run


def _hit(path: str):
    """mapInArrow function: (row, text) to the rows in which one block finds something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _tables(path).search
        for batch in batches:
            found = pa.array([bool(search(alnum_words(x))[0]) for x in text_bytes(batch.column("text"))], pa.bool_())
            yield pa.record_batch([batch.column("row").filter(found)], ["row"])

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of `docs`, with all their columns, that contamination() finds clean.

    Null and empty texts stay, repeated rows share one fate, columns of any name are kept as they are; an empty benchmark
    or an empty table changes nothing.
    """
    paths = pattern_tables(benchmark, window)
    if len(paths) <= 1:
        return docs.mapInArrow(_clean(paths[0]), docs.schema) if paths else docs
    row = fresh(docs, "row")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "benchmark-rows")
    narrow = rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
    found = [staged(narrow.mapInArrow(_hit(path), "row long"), "benchmark-found") for path in paths]
    hit = staged(reduce(DataFrame.unionByName, found).distinct(), "benchmark-hit").select(F.col("row").alias(row))
    return rows.join(small_side(hit, 16), row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
