"""Small documents with what the operators must bear: nulls, empty, long and repeated texts, copies, clashing columns."""

import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, rep string, key string, words string, size int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    bits = ["the", "ing", "tion", "er", "and", "on", "re", "th", "ea", "st"]
    return " ".join("".join(r.choice(bits) for _ in range(r.randint(1, 3))) + r.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source): exact and near copies, shared passages, junk, short, empty and null texts."""
    base = [prose(i, 60 + 7 * i) for i in range(12)]
    near = base[3].split()
    near[20] = "changed"
    texts = [*base, base[3], base[3], " ".join(near), base[5].upper(), base[6] + " " + base[7], "short text", "short text", "", None, " \n\t ", "one", prose(50, 4000), "a b c d e " * 40]
    passage = " ".join(prose(99, 30).split())
    texts += [prose(60 + i, 40) + "\n" + passage + "\n" + prose(70 + i, 40) for i in range(6)]
    texts += ["Der über größe Straße. " * 3, "naïve café, ‘quoted’ 中文字 é́ 𝄞 !!! ###$$$", "released under the MIT License. Apache License, Version 2", "cc by nc cc by nc under the mit license"]
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "c"][i % 4]) for i, t in enumerate(texts)]
    return [*rows, (3, texts[3], "en", "b"), (None, "a row without an id " * 6, None, "a")]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(*r, 0, "x", "y", "z", 1) for r in corpus]
    return spark.createDataFrame(rows, KINDS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KINDS)
