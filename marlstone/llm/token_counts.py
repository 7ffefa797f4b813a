"""Token counts of documents in flat token files without an index, by a scan for end-of-document ids.

Files are cut into blocks that tasks read on their own. A block is searched at once for the separator; what a block
knows alone is where its separators are. The number of documents and the last separator before each block come
from a running sum and a running maximum over the blocks of its file, which stitches the documents that cross blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import partitions_for, scratch_dir, staged
from ._tokens import PIECE_BYTES, TOKENIZER, encoder, store, with_end
from ._words import pieces, text_bytes

#: Bytes of a block; of a file when flat files are written here.
BLOCK_BYTES, FILE_BYTES = 4 << 20, 64 << 20
#: <|endoftext|> of word_bpe_49k.json.
SEPARATOR = 49407


def _write_flat(folder: str, tokenizer: str, separator: int):
    """mapInArrow function: (doc_id, text) to flat files; a row for each batch and file with the documents in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, size, docs = TaskContext.get().partitionId(), 0, None, 0, 0
        words = encoder(tokenizer, special_as_text=True)
        path = ""
        for batch in batches:
            names = []
            for _, texts in pieces(text_bytes(batch.column("text")), PIECE_BYTES):
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        out.close()
                    path, size, docs, number = f"{folder}/{part:07d}-{number:05d}-{uuid.uuid4().hex[:8]}.bin", 0, 0, number + 1
                    fs, at = store(path)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(at)
                own = with_end(*words.encode_all(texts), separator)[0].tobytes()
                out.write(own)
                size += len(own)
                names += [(path, docs + i) for i in range(len(texts))]
                docs += len(texts)
            paths, places = zip(*names, strict=True) if names else ((), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(paths, pa.string()), pa.array(places, pa.int64())], ["doc_id", "path", "ordinal"])
        if out is not None:
            out.close()

    return run


def write_flat_files(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """Writes the ids of `docs` (doc_id, text) to flat files under `folder`, each document followed by the separator.

    No rows move; each task writes its own files. Gives (doc_id, path, ordinal): where each document stands, written.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(plain.mapInArrow(_write_flat(folder, tokenizer, separator), "doc_id long, path string, ordinal long"), "flat-documents")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("path").to_pylist()
        sizes = [fs.get_file_info(at).size for fs, at in map(store, paths)]
        yield pa.record_batch([batch.column("path"), pa.array(sizes, pa.int64())], ["path", "bytes"])


def _separators(width: int, separator: int):
    """mapInArrow function: blocks (path, block, from_id, n) to where their separators stand in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, begin, n in zip(*(batch.column(c).to_pylist() for c in ("path", "from_id", "n")), strict=True):
                fs, at = store(path)
                with fs.open_input_file(at) as file:
                    file.seek(begin * width)
                    ids = np.frombuffer(file.read(n * width), f"<u{width}")
                found = np.flatnonzero(ids == separator).astype(np.int64) + begin
                rows.append((len(found), int(found[-1]) if len(found) else None, found.tobytes()))
            count, last, found = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch.column("path"), batch.column("from_id"), batch.column("n"), pa.array(count, pa.int64()), pa.array(last, pa.int64()), pa.array(found, pa.binary())], ["path", "from_id", "n", "found", "last", "places"])

    return run


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with what stands before them to documents (path, ordinal, start, n_tokens, ended)."""
    for batch in batches:
        for path, base, before, places, tail in zip(*(batch.column(c).to_pylist() for c in ("path", "base", "before", "places", "tail")), strict=True):
            ends = np.frombuffer(places, np.int64)
            starts = np.concatenate([[before + 1], ends[:-1] + 1]) if len(ends) else ends
            ended = np.ones(len(ends), bool)
            if tail is not None:  # the last block of a file that doesn't end with a separator
                after = int(ends[-1]) + 1 if len(ends) else before + 1
                starts, ends, ended = np.append(starts, after), np.append(ends, tail), np.append(ended, False)
            n = len(ends)
            yield pa.record_batch([pa.array([path] * n, pa.string()), pa.array(np.arange(base, base + n, dtype=np.int64)), pa.array(starts.astype(np.int64)), pa.array((ends - starts).astype(np.int64)), pa.array(ended)], ["path", "ordinal", "start", "n_tokens", "ended"])


def scan_flat_files(paths: DataFrame, width: int = 2, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, start, n_tokens, ended) of each document in the flat files named by `paths` (path).

    ordinal and start, in ids, count from 0 in each file; n_tokens leaves the separator out. Ids after the last
    separator of a file are a document that is not ended. Separators that follow one another end empty documents; empty
    files hold none. Files hold little-endian unsigned ids of `width` bytes; bytes beyond the last whole id are left out.
    Repeated and null paths count once and not at all.
    """
    spark = paths.sparkSession
    step = max(1, block_bytes // width)
    files = staged(paths.select("path").where("path is not null").distinct().mapInArrow(_measure, "path string, bytes long"), "flat-files")
    sized = files.withColumn("ids", F.floor(F.col("bytes") / width)).where("ids > 0")
    blocks = sized.select("path", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ids") - 1, F.lit(step).cast("long"))).alias("from_id"))
    blocks = blocks.select("path", "from_id", F.least(F.lit(step), F.col("ids") - F.col("from_id")).cast("long").alias("n"))
    found = blocks.repartition(partitions_for(spark), "path", "from_id").mapInArrow(_separators(width, separator), "path string, from_id long, n long, found long, last long, places binary")
    found = staged(found, "flat-blocks")
    earlier = Window.partitionBy("path").orderBy("from_id").rowsBetween(Window.unboundedPreceding, -1)
    following = F.lead("from_id").over(Window.partitionBy("path").orderBy("from_id"))
    base, before = F.coalesce(F.sum("found").over(earlier), F.lit(0)), F.coalesce(F.max("last").over(earlier), F.lit(-1))
    # the scan itself needs the sums only: the places stay where they are
    scan = found.select("path", "from_id", "n", "found", "last").select("path", "from_id", base.alias("base"), before.alias("before"), "n", "last", following.alias("following"))
    end = F.col("from_id") + F.col("n")
    tail = F.when(F.col("following").isNull() & (F.coalesce("last", "before") < end - 1), end)
    placed = found.select("path", "from_id", "places").join(scan.select("path", "from_id", "base", "before", tail.alias("tail")), ["path", "from_id"])
    return placed.mapInArrow(_stitch, "path string, ordinal long, start long, n_tokens long, ended boolean")


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, start, file_ordinal) of each row of `docs` (doc_id long, text string).

    Writes the documents' ids to flat files in the shared scratch folder and counts them by scanning those. n_tokens
    leaves the separator out; start and file_ordinal are the place in the file. Null and empty texts have no tokens.
    Repeated rows give repeated results, a null doc_id stays null, other columns are ignored, an empty table gives no rows.
    """
    placed = write_flat_files(docs, scratch_dir(docs.sparkSession, "flat-tokens"), tokenizer)
    counted = scan_flat_files(placed.select("path"))
    return placed.join(counted, ["path", "ordinal"]).select("doc_id", "n_tokens", "start", F.col("ordinal").alias("file_ordinal"))
