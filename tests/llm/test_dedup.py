"""Near-duplicates and repeated passages against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm.near_dup import connected, near_duplicates, one_of_each
from marlstone.llm.substring_dedup import drop_repeated_passages

SPACED = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = SPACED.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a == b or (s and t and 100 * len(s & t) >= 75 * len(s | t)):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def test_near_duplicates_equal_brute_force(docs, corpus):
    want = brute_components(corpus)
    got = near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    sizes = {r.doc_id: r.n_shingles for r in got}
    assert all(sizes[i] == len(shingles(t)) for i, t, *_ in corpus)


def test_near_duplicates_of_real_rows(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = brute_components(rows)
    got = near_duplicates(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_a_large_group_of_near_copies(spark):
    """More copies than a cluster's block holds, each with its own change, in a chain of alterations."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(700):
        w = list(base)
        w[i % 120] = f"own{i}"
        w[(i * 7) % 120] = f"other{i}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_near_duplicates_of_nothing(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_one_of_each_keeps_one_row(docs, corpus):
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = brute_components(corpus)
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    nodes = sorted({x for e in edges for x in e} | {7777})
    got = connected(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.comp for r in got.collect()} == {n: 0 if n <= 40 else 100 if n < 7777 else 7777 for n in nodes}


def brute_passages(rows, k=20):
    first, out = {}, {}
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(float("inf") if i is None else i, []).append(t)
    for i in sorted(texts):
        for t in texts[i]:
            w = SPACED.findall(t or "")
            for s in range(len(w) - k + 1):
                key = tuple(w[s : s + k])
                first[key] = min(first.get(key, (i, s)), (i, s))
    for i in texts:
        w = SPACED.findall(texts[i][0] or "")
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (i, s):
                gone[s : s + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[None if i == float("inf") else i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_passages_equal_brute_force(docs, corpus):
    want = brute_passages(corpus)
    got = drop_repeated_passages(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_rows_without_an_id_are_documents_of_their_own(spark):
    """A third of the rows lacks an id: copies, shared passages at several places, text of its own; ids that are shared."""
    word = lambda i, n: " ".join(f"x{i}y{j}" for j in range(n))
    shared = word("s", 30)
    rows = [(None, word("copy", 150))] * 40 + [(None, word(i, 50 + i) + " " + shared + " " + word(-i, 60)) for i in range(5)] + [(None, word("r", 100) + " " + word("r", 40)), (None, word("alone", 160)), (None, None), (None, "")]
    rows += [(i, word(100 + i, 140)) for i in range(60)] + [(7, word("other", 140)), (7, word("more", 30) + " " + shared), (8, word(109, 140)), (9, word("copy", 25))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    digest = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, digest[rows[i][1]]))
    seen, want = set(), []
    for i in order:
        w = (rows[i][1] or "").split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        want.append((rows[i][0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in drop_repeated_passages(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[3] == word("copy", 150) for r in got) == 0 and sum(r[0] is None and r[2] == 125 + 25 for r in got) == 39


def test_passages_with_many_small_groups(docs, corpus, monkeypatch):
    import marlstone.llm.substring_dedup as S

    monkeypatch.setattr(S, "GROUP", 500)
    want = brute_passages(corpus)
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in drop_repeated_passages(docs).collect())


def test_passages_with_more_slots_than_an_array_counts(docs, corpus, monkeypatch):
    """Slots are counted a piece of text at a time, and most are named by no table."""
    import marlstone.llm.substring_dedup as S

    monkeypatch.setattr(S, "SLOT_BITS", S.ARRAY_BITS + 2)
    monkeypatch.setattr(S, "GROUP", 500)
    want = brute_passages(corpus)
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in drop_repeated_passages(docs).collect())


@pytest.mark.parametrize("total", [10**8, 10**10, 10**11])
def test_slots_grow_with_the_corpus(total):
    """Slots of heavy tails, drawn apart for each level: few suffixes reach the last level, groups stay even, tables small."""
    import marlstone.llm.substring_dedup as S

    slots, parts = 1 << S._slot_bits(total), max(8, total // S.GROUP)
    left, rng = 1.0, np.random.default_rng(1)
    for _ in S.LEVELS:
        n = rng.pareto(1.5, slots)
        n = (n * (total / n.sum())).astype(np.int64)
        fits = max(S.GROUP // 8, total // (4 * parts))
        named = np.flatnonzero(n > min(fits, max(fits // 8, 8 * total // slots)))
        group = S._group_of(np.arange(slots), S._routes(named, n[named], fits, parts), parts)
        went = group >= 0
        assert len(named) <= slots / 8 and not (n[went] > fits).any()
        assert np.bincount(group[went], n[went], parts).max() < 3 * S.GROUP
        left *= 1 - n[went].sum() / n.sum()
    assert left < 0.05


@pytest.mark.parametrize("window", [2, 3, 20])
def test_passages_of_equal_fingerprints_are_told_apart_by_their_words(monkeypatch, tmp_path, window):
    """Hashes of a few bits only: most suffixes share theirs, so that words alone decide."""
    import marlstone.llm.substring_dedup as S

    strong, parts = S.window_hashes, 3
    monkeypatch.setattr(S, "window_hashes", lambda h, k: strong(h, k) & np.uint64(0x7000000000000007))
    monkeypatch.setattr(S, "LEAVES", 40)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 6, 60)) for _ in range(30)]
    texts += [" ".join(texts[3].split()[7:55]), texts[4], "", "w1", texts[5] + " " + texts[5]]
    path = f"file://{tmp_path}/every.routes"  # even slots to group 1, odd ones to the next level
    slots = np.arange(1 << S.SLOT_BITS)
    S.write_file(path, np.stack([slots, np.where(slots % 2, -1, 1)]).tobytes())
    paths = [path] * (len(S._levels(window)) - 1)
    sent = []
    for at in range(0, len(texts), 8):
        batch = pa.record_batch([pa.array(range(at, at + len(texts[at : at + 8]))), pa.array(texts[at : at + 8])], ["place", "text"])
        sent += [b for b in S._suffixes(window, paths, S.SLOT_BITS, parts)(iter([batch]))]
    table = pa.Table.from_batches(sent).sort_by("part")
    found = set()
    for b in S._repeats(window, parts)(iter(table.to_batches())):
        for blob in b.column("places").to_pylist():
            found |= set(zip(*(x.tolist() for x in S._unpack(blob)), strict=True))
    first, want = set(), set()
    for i, t in enumerate(texts):
        w = t.split()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            want |= {(i, s)} if key in first else set()
            first.add(key)
    assert want and found == want


def test_passages_of_a_long_text(spark):
    """One text of millions of bytes that repeats itself and is repeated by others."""
    long = " ".join(f"v{i % 230_000}" for i in range(500_000))
    rows = [(1, long), (2, "start " + " ".join(f"v{i}" for i in range(100, 160)) + " end"), (None, long[:4_000_000])]
    got = {r.doc_id: r for r in drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_removed) == (500_000, 270_000)
    assert (got[2].n_removed, got[2].kept_text) == (60, "start end")
    assert got[None].n_words - got[None].n_removed <= 1


def test_passages_of_nothing(no_docs):
    assert drop_repeated_passages(no_docs).collect() == []
