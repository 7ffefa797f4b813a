"""The filter audit, packing and tokenizer alignment, against brute force on small documents."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from marlstone.llm import tokenizer_alignment as T
from marlstone.llm.entries import QUERIES
from marlstone.llm.filter_audit import audit_filters
from marlstone.llm.packing import cut_documents, pack_documents, packed_sequences, place_pieces, plan_slots

LABELS = "doc_id long, quality int, toxic int, text string, lang string"


def audited(rows, labels):
    """The audit's rows as plain loops give them."""
    good, toxic = ({i for i, q, t, *_ in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    failing, of_part = defaultdict(set), defaultdict(set)
    for n, (i, text, lang, *_) in enumerate(rows):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        of_part[lang or ""].add(n)
        tests = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search(r"[#$%&*|]", text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows),
        }
        for f, fails in tests.items():
            if fails:
                failing[f].add(n)
    out = []
    for part, own in of_part.items():
        steps, total = [], Counter()
        for order in permutations("ABCDE"):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone, fails = left & failing[f], own & failing[f]
                left -= gone
                only = fails - set().union(*(failing[g] for g in "ABCDE" if g != f))
                lost = [sum(rows[n][0] in marked for n in gone) for marked in (good, toxic)]
                steps.append((part, "".join(order), step, len(left), len(gone), len(fails) - len(gone), len(only), *lost))
                total[f] += len(gone)
        out += [(*x, total[x[1][x[2] - 1]]) for x in steps]
    return sorted(out)


def test_audit(spark, docs, corpus, no_docs):
    marks = [(i, i % 3 - 1 if i % 2 else 1, i % 4 % 2, "x", "y") for i in range(0, 40)] + [(3, 0, 1, "x", "y"), (3, 1, 0, "x", "y"), (None, 1, 1, "x", "y"), (999, 1, 1, "x", "y"), (5, None, None, "x", "y")]
    labels = spark.createDataFrame(marks, LABELS)
    got = audit_filters(docs, labels)
    assert sorted(map(tuple, got.collect())) == audited(corpus, marks)
    assert audit_filters(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0
    assert audit_filters(no_docs, labels).count() == 0


def test_audit_of_hot_copies_and_a_long_text(spark):
    """Most rows are one text, whose rows never meet in one task; others share one of many ids."""
    rows = [(i, "one text", "en") for i in range(400)] + [(i % 5, "two $", None) for i in range(50)] + [(None, "one text", "en")] * 30
    rows += [(1000, " ".join(f"w{i}" for i in range(300_000)), "en"), (1001, "A" * 2_000_000, "de"), (1002, "", "de"), (1003, None, "de")]
    marks = [(i, i % 2, 0, "", "") for i in range(0, 400, 7)]
    got = audit_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, LABELS))
    assert sorted(map(tuple, got.collect())) == audited(rows, marks)


def best_fit(lengths, capacity):
    """The number of sequences that best fit takes, piece by piece from the longest."""
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [(left, k) for k, left in enumerate(room) if left >= length]
        if fits:
            room[min(fits)[1]] -= length
        else:
            room.append(capacity - length)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_the_plan_is_best_fit(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 50, 2048])
    lengths = [min(capacity, 1 + int(r.expovariate(1 / (capacity / r.choice([3, 10, 40]))))) for _ in range(r.choice([1, 60, 700]))]
    taken, ranks = defaultdict(list), defaultdict(list)
    for length, rank, slots, each, first, offset in plan_slots(Counter(lengths), capacity):
        for k in range(slots):
            taken[first + k // each].append((offset + k % each * length, length))
            ranks[length].append(rank + k)
    assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(c)) for n, c in Counter(lengths).items()}
    for parts in taken.values():
        parts.sort()
        assert all(at + n == after for (at, n), (after, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(parts[-1]) <= capacity
    assert len(taken) == best_fit(lengths, capacity)


def test_a_plan_is_short_for_many_documents():
    r = np.random.default_rng(1)
    few = {int(n): int(c) for n, c in enumerate(r.integers(1, 1000, 2048), 1)}
    many = {n: c * 10**7 for n, c in few.items()}
    assert len(plan_slots(many)) < 40_000
    assert max(first + -(-slots // each) for _, _, slots, each, first, _ in plan_slots(many)) * 2048 < 1.03 * sum(n * c for n, c in many.items()) + 2048


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(spark, docs, corpus, no_docs, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    cut = cut_documents(docs, capacity)
    placed = place_pieces(cut, capacity)
    rows = placed.collect()
    want = Counter()
    for doc_id, text, *_ in corpus:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            own = ids[k : k + capacity]
            want[doc_id, k // capacity, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    of = defaultdict(list)
    for r in rows:
        of[r.sequence_id].append((r.offset, r.length, r.ids_crc32))
    for parts in of.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1][:2]) <= capacity
    assert len(of) == best_fit([r.length for r in rows], capacity)
    whole = {r.sequence_id: bytes(r.ids) for r in packed_sequences(cut, placed).collect()}
    assert all(zlib.crc32(whole[s][4 * a : 4 * (a + n)]) == crc for s, parts in of.items() for a, n, crc in parts) and whole.keys() == of.keys()
    assert pack_documents(no_docs, capacity).count() == 0


def test_packing_of_one_hot_length_and_a_long_text(spark):
    rows = [(i % 7, "the same few words") for i in range(3000)] + [(None, None), (9, " ".join(f"w{i % 977}" for i in range(300_000)))]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    places = Counter((r.sequence_id, r.offset) for r in got)
    assert max(places.values()) == 1 and sum(r.doc_id == 9 for r in got) == -(-sum(r.length for r in got if r.doc_id == 9) // 2048)
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 2048)


class Plain:
    """Both tokenizers over whole texts, and groups by walking along them."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [x for x in range(256) if x not in seen]
        self.byte_of = {chr(x): x for x in seen} | {chr(256 + k): x for k, x in enumerate(hidden)}

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_bytes = [bytes(self.byte_of[c] for c in self.a.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
            return []
        a_end, b_end = np.cumsum([*map(len, a_bytes)]), np.cumsum([*map(len, b_bytes)])
        out, i, j = [], 0, 0
        for cut in sorted(set(a_end.tolist()) & set(b_end.tolist())):
            p, q = int(np.searchsorted(a_end, cut)) + 1, int(np.searchsorted(b_end, cut)) + 1
            out.append((a[i:p], b[j:q]))
            i, j = p, q
        return out

    def digest(self, rows):
        """The contract's row of each (doc_id, text)."""
        groups = [self.groups(t) for _, t in rows]
        linked = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
        count = Counter(pair for pairs in linked for pair in pairs)
        best = defaultdict(int)
        for (a, _), n in count.items():
            best[a] = max(best[a], n)
        out = []
        for (doc_id, _), g, pairs in zip(rows, groups, linked, strict=True):
            told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            sums = sum(n for p, n in pairs.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in pairs.items())
            sizes = sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(pairs.values())
            out.append((doc_id, *sizes, *sums, hashlib.sha256(told.encode()).hexdigest() if g else ""))
        return out


BITS = [" ", " ", "  ", "\n", "\t", "a", "bc", "é", "ß", "中", "文字", "<s>", "<|endoftext|>", "'s", "12", "3.14", "###", "\r\n", "\x00", "\x7f", "\x85", "𝄞", "the", " and ", "<0x41>", "</s>", "　", " ", "﻿", "😀", "ل"]
COLUMNS = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


@pytest.fixture(scope="module")
def odd():
    r = random.Random(8)
    rows = [(i, "".join(r.choice(BITS) for _ in range(r.randint(0, 40)))) for i in range(400)]
    rows += [(None, None), (None, "text without an id "), (7, " a "), (7, "x▁y"), (8, "▁"), (9, " "), (10, "a \n"), (11, ""), (12, "<|endoftext|>"), (13, "o" * 5000), (14, "same"), (14, "same")]
    return rows


def of_columns(rows):
    return Counter(tuple(r[c] for c in COLUMNS) for r in rows)


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, docs, corpus, odd, no_docs, monkeypatch, small):
    if small:  # runs of a text, stretches and blocks of links far below their sizes
        for name, value in {"PIECE_BYTES": 400, "LINKS": 300, "BIG_GROUP": 6, "STRETCH": 7}.items():
            monkeypatch.setattr(T, name, value)
        texts = [t.encode() for _, t in odd if t]
        words, plain = T.PairEncoder(), Plain()
        for text, x in zip(texts, T._documents(texts, words), strict=True):
            pairs = Counter((a << 16) | b for p, q in plain.groups(text.decode()) for a in p for b in q)
            assert dict(zip(x.pairs.tolist(), x.times.tolist(), strict=True)) == dict(pairs)
        return
    rows = [(r[0], r[1]) for r in corpus] + odd
    frame = docs.select("doc_id", "text", "rep", "words").unionByName(spark.createDataFrame([(*r, "x", "y") for r in odd], "doc_id long, text string, rep string, words string"))
    assert of_columns(T.align_tokenizers(frame).collect()) == Counter(Plain().digest(rows))
    assert T.align_tokenizers(no_docs).count() == 0
    told = {(r.doc_id, tuple((tuple(g.a), tuple(g.b)) for g in r.groups)) for r in T.aligned_groups(frame).collect()}
    assert told == {(i, tuple((tuple(a), tuple(b)) for a, b in Plain().groups(t))) for i, t in rows}


def test_pairs_of_a_document_in_several_chunks(spark, odd):
    """A text of more different pairs than a chunk holds has one row all the same; chunks don't change counts."""
    r = random.Random(5)
    rows = odd + [(100 + k, " ".join("".join(chr(97 + r.randrange(26)) for _ in range(6)) for _ in range(400))) for k in range(6)]

    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    usual, again = T.align_tokenizers(frame).collect(), T.align_tokenizers(frame, chunk_pairs=700).collect()
    assert of_columns(usual) == of_columns(again) == Counter(Plain().digest(rows))


def test_alignment_of_a_long_text(spark):
    text = " ".join(f"w{i % 9973}é{i % 7}" for i in range(400_000))
    (got,) = T.align_tokenizers(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert tuple(got[c] for c in COLUMNS) == Plain().digest([(1, text)])[0]


@pytest.mark.parametrize("name", ["op12_best_fit_packing", "op13_tokenizer_alignment"])
def test_registered_queries(spark, data, name):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = QUERIES[name](spark, data).collect()
    if name.startswith("op13"):
        assert of_columns(got) == Counter(Plain().digest(rows))
    else:
        assert {r.doc_id for r in got} == {i for i, _ in rows} and len({r.sequence_id for r in got}) == best_fit([r.length for r in got], 2048)
