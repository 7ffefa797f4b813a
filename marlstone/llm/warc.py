"""WARC archives: one gzip stream a file, normalised to one gzip member a record with an index beside it.

The normaliser inflates a monolithic archive once, in pieces, cuts the stream into records by their Content-Length, and
writes each record as a gzip member of its own; the index gives the offset and length of every member, so that one
record can be read without the others.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import partitions_for, scratch_dir, small_side, staged
from ._tokens import read_file, store

#: Bytes of payload after which an archive is closed, and gzip's level.
ARCHIVE_BYTES, LEVEL = 48 << 20, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed date, so that equal inputs give equal archives.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with its payload, or a revisit record without; both tell the full payload's length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The WARC headers, lower-cased, the HTTP headers (empty if the block is none of HTTP) and the payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    if not fields.get("content-type", "").startswith("application/http"):
        return {"fields": fields, "http": "", "payload": block}
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": http.decode("latin-1"), "payload": payload}


def records_of(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive that comes in pieces."""
    held = bytearray()
    at = 0
    for piece in stream:
        held += piece
        while True:
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            told = [x.split(b":", 1)[1] for x in bytes(held[at:end]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
            if not told:
                raise ValueError("a record without Content-Length")
            length = int(told[0])
            if len(held) < end + 8 + length:
                break
            yield bytes(held[at : end + 8 + length])
            at = end + 8 + length
        del held[:at]
        at = 0
    if bytes(held).strip():
        raise ValueError("the archive ends within a record")


def inflated(file, piece: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or several, in pieces of at most `piece` bytes but for a member's last.

    Zeros before, between and behind members are padding; a member without its end is an error.
    """
    engine = None
    while data := file.read(piece):
        while data:
            if engine is None:
                data = data.lstrip(b"\0")
                if not data:
                    break
                engine = zlib.decompressobj(31)
            yield engine.decompress(data, piece)
            data, engine = (engine.unused_data, None) if engine.eof else (engine.unconsumed_tail, engine)
    if engine is not None:
        yield engine.flush()
        if not engine.eof:
            raise ValueError("the archive ends within a gzip member")


def normalise(source: str, target: str) -> list[tuple[int, int]]:
    """Rewrites the archive `source` as `target`, with an index at target + ".idx"; (offset, length) of each record.

    One record at a time is held whole, inflated, beside its compressed form. A damaged archive is an error.
    """
    index, offset = [], 0
    fs, at = store(source)
    out_fs, out_at = store(target)
    out_fs.create_dir(out_at.rsplit("/", 1)[0], recursive=True)
    with fs.open_input_file(at) as file, out_fs.open_output_stream(out_at, compression=None) as out:
        for raw in records_of(inflated(file)):
            member = gzip.compress(raw, LEVEL, mtime=0)
            out.write(member)
            index.append((offset, len(member)))
            offset += len(member)
    with out_fs.open_output_stream(out_at + ".idx", compression=None) as out:
        out.write("".join(json.dumps({"offset": a, "length": n}) + "\n" for a, n in index).encode())
    return index


def _write(folder: str):
    """mapInArrow function: records to monolithic archives; a row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, path, out, engine, size = TaskContext.get().partitionId(), 0, None, None, None, 0
        for batch in batches:
            closed = []
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "revisit")]
            payloads = batch.column("html").cast(pa.binary()).to_pylist()
            for page, url, digest, refers, revisit, payload in zip(*cols, payloads, strict=True):
                if out is None:
                    path, number, size = f"{folder}/{part:07d}-{number:05d}-{uuid.uuid4().hex[:8]}.warc.gz", number + 1, 0
                    fs, at = store(path)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out, engine = fs.open_output_stream(at, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(engine.compress(record(page, url, payload or b"", base32_sha1(digest), refers, revisit)))
                size += len(payload or b"")
                if size >= ARCHIVE_BYTES:
                    out.write(engine.flush())
                    out.close()
                    closed.append(path)
                    out = None
            yield pa.record_batch([pa.array(closed, pa.string())], ["path"])
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pa.record_batch([pa.array([path], pa.string())], ["path"])

    return run


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for path in batch.column("path").to_pylist():
            target = path.removesuffix(".warc.gz") + f"-{uuid.uuid4().hex[:8]}.members.warc.gz"
            normalise(path, target)
            made.append(target)
        yield pa.record_batch([pa.array(made, pa.string())], ["path"])


def read_record(path: str, offset: int, length: int) -> dict:
    """One record of a normalised archive, by its place in the index."""
    fs, at = store(path)
    with fs.open_input_file(at) as file:
        file.seek(offset)
        return parse(gzip.decompress(file.read(length)))


_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string())])


def described(path: str, got: dict) -> tuple:
    """A row of _RECORD for a parsed record. A revisit's size is what its HTTP headers tell; a missing digest is computed."""
    fields, kind = got["fields"], got["fields"].get("warc-type", "")
    told = [int(x.split(":")[1]) for x in got["http"].split("\r\n") if x.lower().startswith("content-length:") and x.split(":")[1].strip().isdigit()]
    size, digest = len(got["payload"]), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        size = told[0] if told else None
    elif kind == "response" and told and told[0] != size and "transfer-encoding" not in got["http"].lower():
        raise ValueError(f"{path}: a payload of {size} bytes, not {told[0]}")
    if digest is None and kind != "revisit":
        digest = base32_sha1(hashlib.sha1(got["payload"]).hexdigest())
    return fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), size, digest, fields.get("warc-refers-to")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            index = [json.loads(x) for x in read_file(path + ".idx").decode().splitlines()]
            fs, at = store(path)
            with fs.open_input_file(at) as file:
                for begin in range(0, len(index), 2000):
                    rows = []
                    for entry in index[begin : begin + 2000]:
                        file.seek(entry["offset"])
                        rows.append(described(path, parse(gzip.decompress(file.read(entry["length"])))))
                    yield pa.record_batch([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of `pages` (page_id, url, html) to monolithic archives; their (path), written.

    Of rows whose html has the same digest, the one of the smallest page_id becomes a response and the others revisit
    it; payloads of fewer than `least_bytes` bytes are always responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    digests = staged(pages.where(F.octet_length("html") >= least_bytes).select("page_id", digest.alias("digest")), "warc-digests")
    # counted before the shuffle in each task, so that a payload that most pages share is a row a task
    repeated = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    repeated = staged(repeated.select(F.col("digest").alias("same"), "first"), "warc-repeated")
    named = pages.withColumn("digest", digest).join(small_side(repeated, 64), (F.col("digest") == F.col("same")) & (F.octet_length("html") >= least_bytes), "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    rows = named.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return staged(rows.mapInArrow(_write(folder), "path string"), "warc-archives")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """Rewrites each archive of `archives` (path) record by record, with an index beside it; their (path), written."""
    return staged(archives.repartition(partitions_for(archives.sparkSession), "path").mapInArrow(_normalise, "path string"), "warc-members")


def read_records(archives: DataFrame) -> DataFrame:
    """(record_id, record_type, target_uri, payload_bytes, payload_digest, refers_to_id) of each record, of any type, of
    normalised archives (path), from whatever program; ids are as they stand in the archive."""
    dealt = archives.repartition(partitions_for(archives.sparkSession), "path")
    return dealt.mapInArrow(_read, "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to_id string")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each response and revisit of normalised
    archives (path). Ids that write_archives() hasn't made are null; records of other types are left out."""
    number = lambda c: F.try_to_number(F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1), F.lit("S9999999999999999999")).cast("long")
    records = read_records(archives).where(F.col("record_type").isin("response", "revisit"))
    refers = F.when(F.col("record_type") == "revisit", number("refers_to_id"))
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes `pages` (page_id long, url string, html string) to archives, normalises those and reads them back.

    Gives a row for each page; digest and size are those of the full payload, for revisits as well. A null html is an
    empty payload, a null url an empty target. Rows that share a page_id and a payload are all its response. A null
    page_id is never the first of equal payloads unless all are null; then all are responses. Other columns are
    ignored, an empty table gives no rows.
    """
    folder = scratch_dir(pages.sparkSession, "warc")
    return read_archives(normalise_archives(write_archives(pages, folder, least_bytes)))


