"""License scan, quality rules, decontamination and language identification against brute force."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from marlstone.llm.decontaminate import clean_documents, contamination
from marlstone.llm.language_id import accepted_documents, held_out, identify_languages
from marlstone.llm.license_scan import PHRASES, scan_licenses
from marlstone.llm.quality_rules import judge_quality, learn_rules, verdict

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def alnum(text):
    return ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def licenses(text):
    w, starts, labels = alnum(text), [], set()
    for label, phrase in PHRASES:
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base_equals_brute_force(docs, corpus):
    want = {i: licenses(t) for i, t, *_ in corpus}
    got = scan_licenses(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_license_notices_that_were_altered(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    words = notice.split()
    altered = " ".join([*words[:9], "kindly", *words[9:]])
    texts = [notice, altered, "GNU General Public License, version 3", "GNU General Public License", "Kelvin \u212a sign under the mit license \u0130", "under the mit licence"]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(6)] == ["mit", "mit", "gpl-3", "", "mit", ""]
    assert got[0].score == 1.0 and 0.6 <= got[1].score < 1.0 and got[0].n_base == 0 and got[4].n_words == 8


def statistics(text):
    t = text or ""
    w = SPACED.findall(t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), sum(hit)


def test_quality_statistics_equal_brute_force(spark, docs, corpus):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = {i: statistics(t) for i, t, *_ in corpus}
    got = judge_quality(docs, labels).collect()
    assert len(got) == len(corpus)
    for r in got:
        n, chars, symbols, lines, repeats = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and r.kept == (not r.base_failed)


def test_rules_are_learned_and_judge_unseen_rows(spark):
    good = [(i, " ".join(f"word{j} with{i}" for j in range(30))) for i in range(200)]
    bad = [(1000 + i, " ".join(f"word{j}### with{i}$$$" for j in range(30))) for i in range(200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(1000 + i, 0) for i in range(150)] + [(None, 0), (5, None)], "doc_id long, quality int")
    rules = learn_rules(docs, labels)
    assert rules and "symbols" in str(rules[0])
    kept = {r.doc_id for r in judge_quality(docs, labels).where("kept").collect()}
    assert kept == set(range(200))
    one = [(i, 1) for i in range(150)]
    assert learn_rules(docs, spark.createDataFrame(one, "doc_id long, quality int")) == []
    assert spark.range(1).select(verdict([])[0]).first()[0] is True


BENCHMARK = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short, Item"), (3, None), (4, ""), (5, "..."), (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "short item"), (None, "nobody counts this")]


def contaminated(text, items, k=10):
    w = alnum(text)
    hit, ids = [False] * len(w), set()
    for item, t in items:
        p = alnum(t)
        m = min(k, len(p))
        for j in range(len(p) - m + 1 if m else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == p[j : j + m]:
                    hit[i : i + m] = [True] * m
                    if item is not None:
                        ids.add(str(item))
    return len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), any(hit)


def test_contamination_equals_brute_force(spark, docs, corpus, monkeypatch):
    import marlstone.llm.decontaminate as D

    more = [(900, "x " + BENCHMARK[0][1].upper() + " y short item"), (901, "short. item short item"), (902, "alpha beta gamma delta epsilon zeta eta theta iota"), (903, "so nobody counts this")]
    rows = [(i, t) for i, t, *_ in corpus] + more
    bench = spark.createDataFrame([*BENCHMARK, (77, corpus[3][1])], "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(1)).withColumn("spans", F.lit("s"))
    want = {i: contaminated(t, [*BENCHMARK, (77, corpus[3][1])]) for i, t in rows}
    for size in (D.BLOCK_BYTES, 60):  # in one block, and in many
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        got = contamination(table, bench).collect()
        assert len(got) == len(rows)
        assert all((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id] for r in got)
        clean = clean_documents(table, bench)
        assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w[4]}
    none = contamination(table, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(rows) and not any(r.contaminated for r in none)


def test_languages_on_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = held_out(F.col("doc_id"))
    found = identify_languages(docs, docs.where(~out)).join(docs.where(out).select("doc_id", "lang"), "doc_id")
    rows = found.collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark, docs, no_docs, corpus):
    got = identify_languages(docs, docs).collect()
    assert len(got) == len(corpus)
    texts = {i: t for i, t, *_ in corpus}
    for r in got:
        t = texts[r.doc_id]
        assert (r.lang_pred == "und") == (t is None or not any(map(str.isalpha, t)))
        assert r.lang_pred != "und" or (r.score == 0 and not r.accepted)
    assert {r.lang_pred for r in identify_languages(docs, no_docs).collect()} == {"und"}
    assert identify_languages(no_docs, docs).collect() == []
    kept = accepted_documents(docs, docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.accepted for r in got)


def test_nothing_gives_nothing(spark, no_docs):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    for out in (scan_licenses(no_docs), judge_quality(no_docs, labels), contamination(no_docs, bench)):
        assert out.collect() == []
