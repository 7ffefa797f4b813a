"""Named cases: clashing columns, archives of other programs, altered licenses, bounded samples, a larger benchmark."""

import gzip
import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from marlstone.llm import decontaminate as D
from marlstone.llm import language_id as L
from marlstone.llm import quality_rules as Q
from marlstone.llm import warc as W
from marlstone.llm._shared import fresh, scratch_dir
from marlstone.llm._tokens import write_file
from marlstone.llm.language_id import accepted_documents, identify_languages
from marlstone.llm.license_scan import NOTICES, scan_licenses
from marlstone.llm.mixing import mixed_documents
from marlstone.llm.near_dup import near_duplicates, one_of_each


def test_columns_of_any_name_stay_as_they_are(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, text if i < 2 else f"{text} {i} " + " ".join(f"z{i}x{j}" for j in range(40)), "s", "a", "b", "c", "d", 7) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, gone_id string, row string, copies string, copy string, size int")
    kept = one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3] and all(r.asDict()["gone_id"] == "a" for r in kept)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {(r["row"], r["copies"], r["copy"], r["size"]) for r in mixed.collect()} == {("b", "c", "d", 7)}
    assert fresh(docs, "Row") == "Row_" and fresh(docs, "other") == "other"
    for out in (one_of_each(docs.limit(0)), mixed_documents(docs.limit(0)), D.clean_documents(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text"))):
        assert out.columns == docs.columns and out.count() == 0


def test_archives_of_other_programs(spark):
    def record(kind, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", *more, f"Content-Length: {len(block)}", "", ""]
        return "\r\n".join(head).encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n<p>hello</p>"
    whole = (
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields", "WARC-Record-ID: <urn:uuid:1>")
        + record("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Record-ID: <urn:uuid:2>")
        + record("response", http, "Content-Type: application/http; msgtype=response", "WARC-Record-ID: <urn:uuid:3>", "WARC-Target-URI: http://x/")
        + record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "Content-Type: application/http", "WARC-Record-ID: <urn:uuid:4>", "WARC-Refers-To: <urn:uuid:3>")
    )
    path = scratch_dir(spark, "foreign") + "/a.warc.gz"
    write_file(path, gzip.compress(whole))
    made = W.normalise_archives(spark.createDataFrame([(path,)], "path string"))
    got = {r.record_id: r for r in W.read_records(made).collect()}
    assert [got[f"<urn:uuid:{i}>"].record_type for i in (1, 2, 3, 4)] == ["warcinfo", "request", "response", "revisit"]
    assert got["<urn:uuid:3>"].payload_bytes == 12 and len(got["<urn:uuid:3>"].payload_digest) == 32 and got["<urn:uuid:3>"].target_uri == "http://x/"
    assert got["<urn:uuid:4>"].refers_to_id == "<urn:uuid:3>" and got["<urn:uuid:4>"].payload_bytes is None
    assert sorted((r.page_id, r.record_type) for r in W.read_archives(made).collect()) == [(None, "response"), (None, "revisit")]
    with pytest.raises(ValueError, match="Content-Length"):
        list(W.records_of(iter([b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"])))


def test_a_license_is_verbatim_only_in_its_order(spark):
    isc = next(words for label, words in NOTICES if label == "isc").split()
    texts = [" ".join(isc), " ".join(isc[:9] + isc[7:14] + isc[12:]), " ".join(sorted(isc)), " ".join(isc[:10] + ["other"] + isc[11:])]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (None, "nothing"), (9, texts[0]), (9, "nothing at all here")], "doc_id long, text string")
    got = scan_licenses(docs).collect()
    score = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 4}
    assert score[0].score == 1.0 and score[0].labels == "isc" and 0.75 < score[1].score < 1.0
    assert score[2].labels == "" and score[2].score == 0.0 and score[3].labels == "isc" and score[3].score < 1.0
    assert sorted(r.labels for r in got if r.doc_id == 9) == ["", "isc"] and sorted(r.labels for r in got if r.doc_id is None) == ["", "isc"]


def test_the_first_labels_of_each_class(spark, monkeypatch):
    monkeypatch.setattr(Q, "FIT_ROWS", 50)
    marked = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 100 == 0).cast("int").alias("bad"), F.xxhash64("id").alias("place"))
    want = {bad: {r.doc_id for r in marked.where(f"bad = {bad}").orderBy("place").limit(50).collect()} for bad in (0, 1)}
    got = Q._first_of_each(marked).collect()
    assert {bad: {r.doc_id for r in got if r.bad == bad} for bad in (0, 1)} == want
    assert Q._first_of_each(marked.limit(0)).count() == 0


def test_ties_of_languages_are_rejected(spark):
    same = "one and the same text for both languages, with some words more. " * 8
    labelled = spark.createDataFrame([(i, same, lang) for i in range(40) for lang in ("aa", "bb")] + [(99, same, "bb")], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, same), (2, None), (3, "123")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score, r.accepted) for r in identify_languages(docs, labelled).collect()}
    assert got[1] == ("bb", 0.0, False) and got[2] == got[3] == ("und", 0.0, False)
    assert accepted_documents(docs, labelled).count() == 0


def test_a_benchmark_of_many_blocks_and_long_items(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 200_000)
    monkeypatch.setattr(D, "PART_BYTES", 20_000)
    long = " ".join(f"l{i}" for i in range(30_000))
    items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(200))) for k in range(300)] + [("long", long), ("short", "just four words here"), (None, "an item without any id of its own that has twelve words")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert len(D.pattern_tables(bench, 10)) > 3
    cut = long.split()
    docs = [(k, f"before {' '.join(t.split()[50:65])} after") for k, (_, t) in enumerate(items[:5])]
    docs += [(100 + k, " ".join(cut[k : k + 10])) for k in range(2500, 2600)] + [(1, " ".join(cut[7:16])), (2, "just four words here"), (3, items[-1][1]), (4, None)]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sum(r.contaminated for r in got) == 5 + 100 + 2
    assert all(r.n_hit == 15 and r.n_items == 1 for r in got if r.n_words == 17) and {r.n_items for r in got if r.n_hit == 12} == {0}
    plan = D.contamination(docs := spark.createDataFrame(docs, "doc_id long, text string"), bench)._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") <= 4 and docs.count() == len(got)


def test_padded_and_damaged_archives():
    """Zeros around members are padding; a member that lacks bytes of its end is refused, whatever the pieces read."""
    body = [b"WARC/1.0 " + bytes([65 + i]) * 5000 for i in range(3)]
    one = gzip.compress(b"".join(body))
    padded = b"\0" * 7 + b"".join(gzip.compress(x) + b"\0" * 600 for x in body)
    for piece in (1, 13, 512, 1 << 20):
        for data in (one, padded, one + b"\0" * 1024):
            found = list(W.inflated(io.BytesIO(data), piece))
            assert b"".join(found) == b"".join(body) and max(map(len, found)) <= max(piece, 15_100)
        for missing in (1, 4, 8, 9, 40):
            with pytest.raises(ValueError):
                list(W.inflated(io.BytesIO(one[:-missing]), piece))
    bomb = gzip.compress(b"\0" * (64 << 20))
    assert max(map(len, W.inflated(io.BytesIO(bomb)))) <= 2 << 20
    assert list(W.inflated(io.BytesIO(b""))) == []


def test_languages_by_a_plain_loop(spark, corpus):
    """The same dictionaries, tried one after the other on each text; and one labelled document of megabytes."""
    langs = ["en", "de", "fr"]
    labelled = [(i, t, langs[i % 3]) for i, (_, t, *_) in enumerate(corpus)] + [(1000, "Lang " * 400_000, "fr")]
    table = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    model = L.fit(table)
    assert set(model) == set(langs) and all(len(x) <= L.DICTIONARY_BYTES for parts in model.values() for x in parts)
    alone = L.fit(table.where("doc_id = 1000"))["fr"]
    assert alone == [b"", L.letters_only("Lang " * 400_000)[-L.DICTIONARY_BYTES :]]
    tools = {k: [zstandard.ZstdCompressor(level=L.LEVEL, dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for x in parts] for k, parts in model.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(table, table).collect()}
    for i, text, _ in labelled:
        if text is None or not any(c.isalpha() for c in text):
            assert got[i] == ("und", 0.0)
            continue
        plain = b" " + L.letters_only(text) + b" "
        parts = [plain[j : j + L.SEGMENT] for j in range(0, len(plain), L.SEGMENT)]
        size = {}
        for k, own in tools.items():
            size[k] = sum(len(own[j % 2].compress(x)) for j, x in enumerate(parts)) if len(parts) > 1 else sum(len(c.compress(plain)) for c in own)
        best, second = sorted(size.values())[:2]
        assert size[got[i][0]] == best and got[i][1] == (second - best) / second


def test_equal_benchmark_items_are_one_text(spark, monkeypatch):
    """Copies of one item share an entry, whose table keeps its bound; all their ids count."""
    monkeypatch.setattr(D, "ENTRY_IDS", 500)
    copied = " ".join(f"c{j}" for j in range(400))
    ids = [f"i{k:05d}" for k in range(20_000)]
    bench = spark.createDataFrame([*((k, copied) for k in ids), (ids[0], copied), (None, copied), ("other", "something else of four words")], "item_id string, text string")
    paths = D.pattern_tables(bench, 10)
    tables = [D.PatternTables.from_bytes(D.read_file(p)) for p in paths]
    assert len(paths) == 1 and len(D.read_file(paths[0])) < 2 * D.BLOCK_BYTES
    sizes = [len(x) for t in tables for x in t.items]
    assert sum(sizes) == 20_001 and max(sizes) < 1000
    docs = spark.createDataFrame([(1, "x " + copied[:200] + " y"), (2, "nothing of it"), (3, None), (3, None)], "doc_id long, text string")
    want = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    for size in (D.BLOCK_BYTES, 20_000):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        got = {r.doc_id: r for r in D.contamination(docs, bench).collect()}
        assert got[1].n_items == 20_000 and got[1].items_sha256 == want and not got[2].contaminated and not got[3].contaminated
        assert D.contamination(docs, bench).count() == 4
        assert sorted(r.doc_id for r in D.clean_documents(docs, bench).collect()) == [2, 3, 3]


@pytest.mark.parametrize("window", [1, 2, 300])
def test_windows_of_any_length(spark, window):
    """Also such as jump further than a byte can say, and a document of megabytes."""
    item = [f"w{j % 977}" for j in range(700)]
    text = " ".join(["q"] * 300_000 + item[100:420] + ["q"] * 300_000)
    docs = spark.createDataFrame([(1, text), (2, " ".join(item[:299])), (3, " ".join(item[5:305]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in D.contamination(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"), window).collect()}
    assert got == {1: (600_320, 320), 2: (299, 0 if window == 300 else 299), 3: (300, 300)}


def test_a_family_of_alterations_and_a_long_text(spark):
    """Texts that share most words in a chain: each is near its neighbours only; and one of millions of characters."""
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(30):
        words = list(base)
        for j in range(i):
            words[10 * j % 300] = f"c{j}"
        rows.append((i, " ".join(words)))
    rows.append((500, " ".join(f"t{i % 70_000}" for i in range(400_000))))
    split = {i: t.split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in split.items()}
    up = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = {k: new if v == old else v for k, v in up.items()}
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == up
