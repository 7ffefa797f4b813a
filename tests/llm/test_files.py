"""Token files, token counts, archives, mixing and the pipeline."""

import base64
import gzip
import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marlstone.llm import _tokens, token_binary
from marlstone.llm import warc as W
from marlstone.llm._shared import scratch_dir
from marlstone.llm._tokens import read_file, write_file
from marlstone.llm.mixing import LEAF, mix_sources, mixed_documents, source_targets
from marlstone.llm.token_binary import END_ID, WaveletMatrix, token_files_round_trip
from marlstone.llm.token_counts import scan_flat_files, token_counts


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def opened(ids, reads):
    data = WaveletMatrix.to_bytes(ids, 16)

    def fetch(offset, length):
        reads.append(length)
        return data[offset : offset + length]

    return WaveletMatrix.open(fetch)


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_wavelet_matrix(monkeypatch, bits):
    monkeypatch.setattr(token_binary, "BLOCK_BITS", bits)
    ids = np.random.default_rng(3).integers(0, 49408, 3000).astype(np.uint16)
    ids[5:2000:11] = 777
    m = opened(ids, [])
    places = np.flatnonzero(ids == 777)
    assert (m.decode() == ids).all() and [m.access(i) for i in range(0, 3000, 101)] == ids[::101].tolist()
    assert m.count(777) == len(places) and [m.select(777, k) for k in range(len(places))] == places.tolist()
    assert [m.rank(777, i) for i in (0, 5, 6, 1500, 3000)] == [int((ids[:i] == 777).sum()) for i in (0, 5, 6, 1500, 3000)]
    for wrong in (lambda: m.select(777, len(places)), lambda: m.access(3000)):
        with pytest.raises(IndexError):
            wrong()
    empty = opened(ids[:0], [])
    assert empty.count(1) == 0 and len(empty.decode()) == 0


def test_access_reads_few_blocks():
    ids = np.random.default_rng(4).integers(0, 49408, 1_000_000).astype(np.uint16)
    reads = []
    m = opened(ids, reads)
    reads.clear()
    assert m.access(654_321) == ids[654_321]
    assert len(reads) == 16 and sum(reads) < 16 * 9000  # one block of each plane, of 16 blocks


def test_known_segments_are_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(_tokens, "CACHED_SEGMENTS", 50)
    words = _tokens.SegmentEncoder()
    texts = [*(f"it's word{i} of,many. naïve{i} ab{i}é! x" for i in range(300)), "", "<|endoftext|> is special", "same", "same", "\u0130stanbul cafe\u0301 x\u2260y \u00a0 12ab3 it'sabc", "a" * 300_000]
    for begin in range(0, len(texts), 40):
        part = texts[begin : begin + 40]
        ids, lengths = words.encode_all([x.encode() for x in part])
        want = [x.ids for x in tokenizer.encode_batch(part, add_special_tokens=False)]
        assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]
    assert len(words.known.hash) <= 50 + 200 and len(words.known.hash) == len(words.known.used)


@pytest.mark.parametrize("file_ids", [6_000_000, 500])
def test_token_files(docs, corpus, tokenizer, monkeypatch, file_ids):
    import marlstone.llm.token_binary as B

    monkeypatch.setattr(B, "FILE_IDS", file_ids)
    got = sorted(token_files_round_trip(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [*sorted(i for i, *_ in corpus if i is not None), None]
    texts, start = {i: t for i, t, *_ in corpus}, 0
    for r in got:
        ids = [*ids_of(tokenizer, texts[r.doc_id]), END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_nothing(no_docs):
    assert token_files_round_trip(no_docs).collect() == [] and token_counts(no_docs).collect() == []


def test_token_counts(docs, corpus, tokenizer):
    texts = {i: t for i, t, *_ in corpus}
    got = token_counts(docs).collect()
    assert len(got) == len(corpus) and all(r.n_tokens == len(ids_of(tokenizer, texts[r.doc_id])) for r in got)


@pytest.mark.parametrize("block", [2, 6, 1 << 20])
def test_documents_that_cross_blocks(spark, block):
    folder = scratch_dir(spark, "flat-test")
    files = {"a": [9, 1, 2, 9, 9, 3, 4, 5, 6, 7, 9], "b": [1, 2, 3, 4, 5], "c": [], "d": [9]}
    for name, ids in files.items():
        write_file(f"{folder}/{name}.bin", np.array(ids, "<u2").tobytes() + (b"\0" if name == "b" else b""))
    paths = spark.createDataFrame([(f"{folder}/{n}.bin",) for n in "aabcd"] + [(None,)], "path string")
    got = sorted((r.path[-5], r.ordinal, r.start, r.n_tokens, r.ended) for r in scan_flat_files(paths, 2, 9, block).collect())
    assert got == [("a", 0, 0, 0, True), ("a", 1, 1, 2, True), ("a", 2, 4, 0, True), ("a", 3, 5, 5, True), ("b", 0, 0, 5, False), ("d", 0, 0, 0, True)]


PAGES = [(1, "http://a", "<p>same é</p>"), (2, "http://b\r\nX: y", "<p>same é</p>"), (3, None, None), (4, "u", ""), (5, "u", "line\r\n\r\nContent-Length: 9\r\n\r\nend"), (0, "z", "<p>same é</p>"), (7, "v", "x" * 200_000), (7, "v", "x" * 200_000)]


@pytest.mark.parametrize("size", [48 << 20, 10])
def test_archives(spark, monkeypatch, size):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", size)
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string").repartition(2)
    first = {}
    for i, _, h in sorted(PAGES, key=lambda p: p[0]):
        first.setdefault(h or "", i)
    got = W.warc_round_trip(pages).collect()
    assert len(got) == len(PAGES)
    texts = {i: (h or "") for i, _, h in PAGES}
    for r in got:
        body = texts[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        head = first[texts[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if head == r.page_id else ("revisit", head))
    assert W.warc_round_trip(pages.limit(0)).collect() == []


def test_least_payload_and_index(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert {r.record_type for r in W.warc_round_trip(pages, least_bytes=1 << 20).collect()} == {"response"}
    made = W.normalise_archives(W.write_archives(pages, scratch_dir(spark, "warc-test"))).collect()
    import json

    records = [(m.path, json.loads(x)) for m in made for x in read_file(m.path + ".idx").decode().splitlines()]
    assert len(records) == len(PAGES)
    whole = W.read_record(*[(p, e["offset"], e["length"]) for p, e in records][0])
    assert whole["fields"]["warc-type"] in ("response", "revisit")
    for path in {p for p, _ in records}:
        members = read_file(path)
        assert list(W.records_of(iter([gzip.decompress(members)]))) == list(W.records_of(W.inflated(io.BytesIO(members), 7)))


def test_source_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 100)], "source string, size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 200 and sum(got.values()) == pytest.approx(1.5 * 2110)
    assert got["c"] == pytest.approx(2 * got["b"])


def test_mixing(docs, corpus, no_docs):
    one, two = (sorted(map(repr, mix_sources(docs).collect())) for _ in range(2))
    assert one == two
    rows = mix_sources(docs).collect()
    assert len(rows) == len(corpus)
    assert all(r["size"] == len((dict((i, t) for i, t, *_ in corpus)[r.doc_id] or "").encode().split()) for r in rows)
    assert all(0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    assert mix_sources(no_docs).collect() == []
    assert mixed_documents(docs).count() == sum(r.copies for r in rows)


def sums(rows):
    out = Counter()
    for r in rows:
        out[r.doc_id, r.source, r["size"]] += r.copies
    return out


@pytest.mark.parametrize("share", [0.4, 0.6, 1.3])
def test_rows_that_share_a_key_get_what_the_mix_takes(spark, share):
    """1,000 rows with neither id nor another size, and repeated ids, each text of its own or repeated."""
    import corpus_pipeline

    rows = [(None, f"own{i} w w", "a", i) for i in range(1000)] + [(i % 7, f"t{i % 20} w", "b", i) for i in range(300)] + [(i, "u " * (i % 9), None, i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(5)
    key = lambda r: (r.doc_id, r.source, len(r.text.split()))
    mix = mix_sources(docs, share).collect()
    out = mixed_documents(docs, share)
    got = out.collect()
    assert out.columns == docs.columns and Counter(map(key, got)) == +sums(mix)
    copies = Counter((r.source, r.n) for r in got)
    assert max(copies.values()) <= 2
    targets = {r.source: r.target for r in mix}
    for source, target in targets.items():
        assert abs(sum(key(r)[2] for r in got if r.source == source) - target) <= 9
    assert sorted(map(repr, got)) == sorted(map(repr, mixed_documents(docs.repartition(3), share).collect()))
    staged_ = corpus_pipeline.mixing(spark, docs, "").collect()
    assert Counter(map(key, staged_)) == +sums(mix_sources(docs).collect())


def test_mixing_over_many_leaves(spark, monkeypatch):
    import marlstone.llm.mixing as X

    monkeypatch.setattr(X, "LEAF", 50)
    monkeypatch.setattr(X, "FAN_IN", 3)
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source")
    rows = mix_sources(docs).collect()
    assert len(rows) == 3000 and LEAF > 50
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 37


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != "token_binary":
            assert out.columns == docs.columns
            path = scratch_dir(spark, "pipeline-test")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            assert 0 < docs.count() and (name == "mixing" or docs.count() <= count)
        else:
            assert out.count() == docs.count()
    assert corpus_pipeline.run(spark, data).count() == docs.count()
