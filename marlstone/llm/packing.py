"""Best-fit packing of documents into sequences, planned over the histogram of lengths.

Texts become token ids, cut into pieces of at most a sequence's capacity. Pieces of one length are alike, so the plan is
made from the number of pieces of each length alone: best fit, from the longest to the shortest, over counts of
pieces and counts of sequences with equal room. Its rows are runs of slots; the pieces take them by their rank within
their length. The plan's size depends on the capacity, not on the number of documents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import small_side, staged
from ._tokens import PIECE_BYTES, TOKENIZER, encoder, with_end
from ._words import pieces, text_bytes

CAPACITY, END_ID = 2048, 0
#: Ranks of a block; pieces and planned slots meet by length and block of ranks.
BLOCK = 256
#: Ids of one batch that a task hands on.
BATCH_IDS = 1 << 20
_PIECE = "row long, doc_id long, piece int, start long, length int, part int, nth long, ids binary"
_SLOTS = "length int, from_rank long, slots long, each long, first_sequence long, from_offset int"


def _cut(tokenizer: str, capacity: int):
    """mapInArrow function: (row, doc_id, text) to pieces; nth counts the task's earlier pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, doc_ids = batch.column("row").to_numpy(), batch.column("doc_id")
            for begin, texts in pieces(text_bytes(batch.column("text")), PIECE_BYTES):
                ids, size = with_end(*words.encode_all(texts), END_ID)
                ids = ids.astype("<u4")
                parts = -(-size // capacity)
                of = np.repeat(np.arange(len(texts)), parts)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                length = np.minimum(size[of] - piece * capacity, capacity)
                order = np.argsort(length, kind="stable")
                lengths, first, n = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(of), np.int64)
                nth[order] = np.arange(len(of)) - np.repeat(first, n) + np.repeat(seen[lengths], n)
                seen[lengths] += n
                edge = np.concatenate([[0], np.cumsum(length)])
                low = 0
                while low < len(of):
                    high = max(low + 1, int(np.searchsorted(edge, edge[low] + BATCH_IDS, side="right")) - 1)
                    own = slice(low, high)
                    where = begin + of[own]
                    offsets = ((edge[low : high + 1] - edge[low]) * 4).astype(np.int32)
                    data = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(offsets), pa.py_buffer(ids[edge[low] : edge[high]])])
                    yield pa.record_batch(
                        [pa.array(rows[where]), doc_ids.take(pa.array(where)), pa.array(piece[own].astype(np.int32)), pa.array(piece[own] * capacity)]
                        + [pa.array(length[own].astype(np.int32)), pa.array(np.full(high - low, part, np.int32)), pa.array(nth[own]), data],
                        ["row", "doc_id", "piece", "start", "length", "part", "nth", "ids"],
                    )
                    low = high

    return run


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of slots (length, from_rank, slots, each, first_sequence, from_offset) for `histogram`, pieces by length.

    The run's slot number k, of the piece with rank from_rank + k within its length, is in the sequence
    first_sequence + k // each at from_offset + k % each * length. This is best fit over pieces from the longest to the
    shortest: each goes where it leaves the least room, into a new sequence if it fits none. Sequences with equal room
    are alike, so they are filled together, as runs of numbers. A length adds three runs of sequences at most, and a run
    of slots for each run of sequences that it meets, so both are bounded by the capacity.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, sequences)
    sizes: list[int] = []  # the keys of room, sorted
    plan, made = [], 0

    def put(left: int, run: tuple[int, int]) -> None:
        if left and left not in room:
            insort(sizes, left)
        if left:
            room.setdefault(left, []).append(run)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                left = sizes[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], sizes[at]
            else:
                left, first, n = capacity, made, -(-todo // (capacity // length))
                made += n
            each = left // length
            full = min(n, todo // each)
            if full:
                plan.append((length, rank, full * each, each, first, capacity - left))
                put(left - each * length, (first, full))
                rank, todo = rank + full * each, todo - full * each
            if todo and full < n:  # the last pieces of this length: fewer than fill a sequence's room
                plan.append((length, rank, todo, todo, first + full, capacity - left))
                put(left - todo * length, (first + full, 1))
                full, todo = full + 1, 0
            if full < n:
                put(left, (first + full, n - full))
    return plan


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of `docs` (doc_id long, text string) of at most `capacity` token ids, as a written table.

    Gives (row, doc_id, piece, start, length, part, nth, ids): `row` numbers the rows of `docs`, start counts the
    document's ids before the piece, ids are little-endian 32-bit integers, (part, nth) is its place among the pieces of
    its length. A document's ids end with END_ID; null and empty texts have that only.
    """
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(plain.mapInArrow(_cut(tokenizer, capacity), _PIECE), "pack-pieces")


def place_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces that cut_documents() gives, without their ids but with ids_crc32, sequence_id and offset."""
    spark = cut.sparkSession
    per = staged(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    # at most `capacity` rows come to the driver, whatever the number of documents
    histogram = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(plan_slots(histogram, capacity), _SLOTS)
    blocks = F.explode(F.sequence(F.floor(F.col("from_rank") / BLOCK), F.floor((F.col("from_rank") + F.col("slots") - 1) / BLOCK)))
    slots = staged(plan.withColumn("block", blocks), "pack-slots")
    # a row of each task that wrote pieces of a length, so the window is short
    before = per.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    light = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")  # ids don't travel
    ranked = light.join(small_side(staged(before, "pack-before"), 32), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    met = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK)).join(small_side(slots, 64), ["length", "block"])
    k = F.col("rank") - F.col("from_rank")
    met = met.where((k >= 0) & (k < F.col("slots")))
    sequence = F.col("first_sequence") + F.floor(k / F.col("each"))
    offset = F.col("from_offset") + k % F.col("each") * F.col("length")
    return met.select("row", "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of `docs` (doc_id long, text string) with their places in sequences of at most `capacity` tokens.

    Gives (row, doc_id, piece, start, length, ids_crc32, sequence_id, offset): ids_crc32 is the checksum of the piece's
    ids as little-endian 32-bit integers, offset its place in the sequence, which has no gaps. Only documents of over
    `capacity` ids are cut; all pieces but the last are whole sequences.

    Null and empty texts have the end id only. Rows are packed apart, also those that share a doc_id or have none. Of
    pieces with equal lengths it doesn't matter which takes which slot. Other columns are ignored, an empty table gives
    no rows. What a row's text takes in memory is one task's.
    """
    return place_pieces(cut_documents(docs, capacity, tokenizer), capacity)


def packed_sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of each sequence: the ids of its pieces in their order, as bytes."""
    met = placed.select("row", "piece", "sequence_id", "offset", "length").join(cut.select("row", "piece", "ids"), ["row", "piece"])
    parts = met.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return parts.select("sequence_id", "length", joined.alias("ids"))
