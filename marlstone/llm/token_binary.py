"""Token ids in files that are wavelet matrices, one for each shard of documents.

A shard's ids stand as bit-planes, from the highest bit to the lowest; after each plane the ids are parted stably into
those with a 0 and those with a 1. A plane is cut into blocks, compressed one by one; a directory in the file's head has
the ones before each block and where it lies. That is enough to give the id at a place (access), the occurrences of an id
before a place (rank) and the place of its k-th occurrence (select): each reads a block or two of each plane.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import partitions_for, scratch_dir, small_side, staged
from ._tokens import PIECE_BYTES, TOKENIZER, encoder, store, with_end, write_file
from ._words import pieces, text_bytes

MAGIC = b"WVM2"
#: Bits of a block; ids of a file; inflated blocks that an open matrix keeps.
BLOCK_BITS, FILE_IDS, KEPT_BLOCKS = 1 << 16, 6_000_000, 256
END_ID = 2


class WaveletMatrix:
    """`fetch` gives (offset, length) bytes of the blocks; zeros, ones and edges are the directory, by plane."""

    def __init__(self, n: int, zeros: list[int], ones: list[np.ndarray], edges: list[np.ndarray], fetch: Callable[[int, int], bytes]):
        self.n, self.zeros, self.ones, self.edges, self._fetch = n, zeros, ones, edges, fetch
        self._inflate = zstandard.ZstdDecompressor().decompress
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def to_bytes(ids: np.ndarray, planes: int) -> bytes:
        """The matrix of `ids` as it stands in a file: head with directory, then blocks."""
        press = zstandard.ZstdCompressor(level=1).compress
        head, blocks, at = [struct.pack("<QBI", len(ids), planes, BLOCK_BITS)], [], 0
        for level in range(planes - 1, -1, -1):
            one = ((ids >> ids.dtype.type(level)) & ids.dtype.type(1)).astype(bool)
            plane = np.packbits(one, bitorder="little").tobytes()
            own = [press(plane[i : i + BLOCK_BITS // 8]) for i in range(0, len(plane), BLOCK_BITS // 8)]
            count = np.add.reduceat(one, np.arange(0, len(ids), BLOCK_BITS), dtype=np.int64) if len(ids) else np.zeros(0, np.int64)
            edge = at + np.cumsum([0, *map(len, own)])
            low = ids[~one]
            head += [struct.pack("<Q", len(low)), np.append(0, np.cumsum(count)).astype("<i8").tobytes(), edge.astype("<i8").tobytes()]
            blocks += own
            at = int(edge[-1])
            ids = np.concatenate([low, ids[one]])
        return b"".join(head + blocks)

    @classmethod
    def open(cls, fetch: Callable[[int, int], bytes]) -> WaveletMatrix:
        """The matrix that `fetch` reads; nothing but the head is read now."""
        n, planes, bits = struct.unpack("<QBI", fetch(0, 13))
        if bits != BLOCK_BITS:
            raise ValueError(f"blocks of {bits} bits")
        edges_of = -(-n // BLOCK_BITS) + 1
        step = 8 + 16 * edges_of
        head = fetch(13, planes * step)
        numbers = [np.frombuffer(head, "<i8", 1 + 2 * edges_of, k * step) for k in range(planes)]
        base = 13 + planes * step
        return cls(n, [int(x[0]) for x in numbers], [x[1 : 1 + edges_of] for x in numbers], [x[1 + edges_of :] + base for x in numbers], fetch)

    def _block(self, k: int, b: int) -> np.ndarray:
        """The bits of a block, packed."""
        if (k, b) not in self._kept:
            if len(self._kept) >= KEPT_BLOCKS:
                self._kept.pop(next(iter(self._kept)))
            a, z = int(self.edges[k][b]), int(self.edges[k][b + 1])
            self._kept[k, b] = np.frombuffer(self._inflate(self._fetch(a, z - a), max_output_size=BLOCK_BITS // 8), np.uint8)
        return self._kept[k, b]

    def _rank1(self, k: int, i: int) -> int:
        block, within = divmod(i, BLOCK_BITS)
        if not within:
            return int(self.ones[k][block])
        bits = self._block(k, block)
        tail = int(bits[within >> 3]) & ((1 << (within & 7)) - 1) if within & 7 else 0
        return int(self.ones[k][block]) + int(np.bitwise_count(bits[: within >> 3]).sum()) + tail.bit_count()

    def _bit(self, k: int, i: int) -> int:
        block, within = divmod(i, BLOCK_BITS)
        return int(self._block(k, block)[within >> 3]) >> (within & 7) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, zeros in enumerate(self.zeros):
            bit = self._bit(k, i)
            ones = self._rank1(k, i)
            value, i = value << 1 | bit, zeros + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """How often the id stands before place i."""
        low, high = 0, i
        for k, zeros in enumerate(self.zeros):
            a, b = self._rank1(k, low), self._rank1(k, high)
            low, high = (zeros + a, zeros + b) if token >> (len(self.zeros) - 1 - k) & 1 else (low - a, high - b)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the id's occurrence number k, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        low = 0
        for p, zeros in enumerate(self.zeros):
            ones = self._rank1(p, low)
            low = zeros + ones if token >> (len(self.zeros) - 1 - p) & 1 else low - ones
        place = low + k
        for p in range(len(self.zeros) - 1, -1, -1):
            one = token >> (len(self.zeros) - 1 - p) & 1
            place = self._find(p, one, place - self.zeros[p] if one else place)
        return place

    def _find(self, k: int, one: int, nth: int) -> int:
        """The place of a plane's nth 1, or 0, from 0."""
        ones = self.ones[k]
        counts = ones if one else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        block = int(np.searchsorted(counts, nth, side="right")) - 1
        bits = np.unpackbits(self._block(k, block), bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(bits == one)[nth - int(counts[block])])

    def decode(self) -> np.ndarray:
        """All ids in order: the partings undone from the lowest plane up, without a jump in memory."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for k in range(len(self.zeros) - 1, -1, -1):
            edge = self.edges[k].tolist()
            raw = self._fetch(edge[0], edge[-1] - edge[0])
            plane = b"".join(self._inflate(raw[a - edge[0] : z - edge[0]], max_output_size=BLOCK_BITS // 8) for a, z in zip(edge[:-1], edge[1:], strict=True))
            one = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(ids)
            above[~one] = ids[: self.zeros[k]]
            above[one] = ids[self.zeros[k] :] | kind(1 << (len(self.zeros) - 1 - k))
            ids = above
        return ids


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, planes: int) -> bytes:
    """A shard's file: documents and their numbers of ids, then the matrix of all ids."""
    named = pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(lengths, pa.int64())], ["doc_id", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, named.schema) as out:
        out.write_batch(named)
    head = zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())
    return MAGIC + struct.pack("<Q", len(head)) + head + WaveletMatrix.to_bytes(ids, planes)


class Shard:
    """An open shard file: its documents, their numbers of ids, and the matrix, whose blocks are read when needed."""

    def __init__(self, path: str):
        fs, at = store(path)
        self._file = fs.open_input_file(at)
        if self._read(0, 4) != MAGIC:
            raise ValueError(f"{path}: not a shard of token ids")
        (size,) = struct.unpack("<Q", self._read(4, 8))
        named = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self._read(12, size))).read_all()
        self.doc_ids, self.lengths = named.column("doc_id").to_pylist(), named.column("n").to_numpy()
        self.matrix = WaveletMatrix.open(lambda offset, length: self._read(12 + size + offset, length))

    def _read(self, offset: int, length: int) -> bytes:
        self._file.seek(offset)
        return self._file.read(length)

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()


def _write(folder: str, tokenizer: str):
    """mapInArrow function: sorted (doc_id, text) to a row for each file written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words = encoder(tokenizer)
        docs, lengths, ids, total, number = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{part:07d}-{number:05d}-{uuid.uuid4().hex[:8]}.wvm"  # another attempt writes other files
            write_file(path, shard_bytes(docs, np.concatenate(lengths), np.concatenate(ids), words.largest.bit_length()))
            return pa.record_batch([pa.array([path]), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([total], pa.int64())], ["path", "part", "number", "n_ids"])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for begin, texts in pieces(text_bytes(batch.column("text")), PIECE_BYTES):
                own, size = with_end(*words.encode_all(texts), END_ID)
                if total and total + len(own) > FILE_IDS:
                    yield flush()
                    docs, lengths, ids, total, number = [], [], [], 0, number + 1
                docs += names[begin : begin + len(texts)]
                lengths.append(size)
                ids.append(own)
                total += len(own)
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Writes the ids of `docs` (doc_id, text) to files under `folder` in the order of doc_id, null last.

    Each document's ids end with END_ID. Gives (path, part, number, n_ids) of each file, as a written table.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = (F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    dealt = plain.repartitionByRange(partitions_for(docs.sparkSession), *order).sortWithinPartitions(*order)  # the hash parts rows that share an id
    return staged(dealt.mapInArrow(_write(folder, tokenizer), "path string, part int, number int, n_ids long"), "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            with Shard(path) as shard:
                ids = shard.matrix.decode().astype("<u4")
            ends = np.cumsum(shard.lengths)
            starts = ends - shard.lengths
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + base), pa.array(shard.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the files that write_token_files() names."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    # one row for each task that wrote; the files of a part are summed apart
    before = parts.select(F.col("part"), (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    placed = files.withColumn("within", within).join(small_side(before, 16), "part").select("path", (F.col("before") + F.col("within")).alias("base"))
    return placed.repartition(partitions_for(files.sparkSession), "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Writes the token files of `docs` (doc_id long, text string) to the shared scratch folder and reads them back.

    Gives (doc_id, start, n_tokens, ids_crc32) of each row: start counts the ids of all documents before it, n_tokens its
    own with the end id, ids_crc32 is the checksum of those as little-endian 32-bit integers.

    Null and empty texts have the end id only. Rows that share a doc_id stand next to each other, in the order of a
    hash of their texts; those without one come last. Other columns are ignored, an empty table gives no rows.
    """
    return read_token_files(write_token_files(docs, scratch_dir(docs.sparkSession, "token-shards"), tokenizer))
