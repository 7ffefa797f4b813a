"""License scan by diagonal voting, in DataFrame operations only.

Every rolling gram of three words of every text is hashed and joined with the grams of the templates. A gram at word p of
a text and word t of a template votes for the diagonal p - t: a full occurrence puts all its votes on one diagonal, an
altered one on neighbouring diagonals, which are merged. What has enough votes is a span, and is verified on the words
themselves, in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import small_side, staged

GRAM = 3
#: Diagonals of a span stand this close; share of a template's grams that vote for a span, all for templates of up to
#: SHORT words; share of its words that stand there.
GAP, VOTES, SHORT, WORDS = 2, 0.6, 12, 0.75
#: Words of a template that its occurrence may leave out at once.
JUMP = 5
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base, then notices of the method's own, by label. Up to 62 words each.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("mpl-2", "mozilla public license version 2"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
]
TEMPLATES = [(label, words.split(), True) for label, words in PHRASES] + [(label, words.split(), False) for label, words in NOTICES]


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, then runs of digits, letters a-z and non-ASCII characters."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # the two characters that lower() would turn into ASCII letters become others that it leaves alone
    kept = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131"))
    parts = F.split(F.lower(kept), DELIMITERS)
    head = (F.get(parts, F.lit(0)) == "").cast("int")
    tail = ((F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == "")).cast("int")
    return F.slice(parts, head + 1, F.size(parts) - head - tail)


def _gram(words: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(GRAM)))


def _template_grams(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(F.xxhash64(*map(F.lit, words[t : t + GRAM])).alias("gram"), F.lit(k).alias("template"), F.lit(t).alias("t"))
        for k, (_, words, _) in enumerate(TEMPLATES)
        for t in range(len(words) - GRAM + 1)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _of_template(k: Column, values: list) -> Column:
    """The value of template number k; values are numbers, strings or lists of strings."""
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.get(F.array(*map(lit, values)), k)


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, template, start, stop) of what may be an occurrence: a full diagonal of a phrase, or merged ones.

    Rows vote by doc_id and a hash of their text, so that only equal ones vote together.
    """
    words = docs.select("doc_id", F.xxhash64("text").alias("digest"), words_of(F.col("text")).alias("words"))
    last = F.size("words") - GRAM
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _gram(F.col("words"), i)))
    votes = words.select("doc_id", "digest", F.posexplode(grams).alias("p", "gram")).join(F.broadcast(_template_grams(docs.sparkSession)), "gram")
    key = ["doc_id", "digest", "template"]
    voted = (
        votes.withColumn("diagonal", F.col("p") - F.col("t"))
        .groupBy(*key, "diagonal")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t"))).alias("seen"))
    )
    voted = staged(voted, "license-votes")  # texts are read once; what follows are two uses of few rows
    along = Window.partitionBy(*key).orderBy("diagonal")
    away = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > GAP, F.lit(True))
    merged = voted.withColumn("span", F.sum(away.cast("int")).over(along))
    sizes = [len(w) for _, w, _ in TEMPLATES]
    grams_in, base = _of_template(F.col("template"), [n - GRAM + 1 for n in sizes]), _of_template(F.col("template"), [b for _, _, b in TEMPLATES])
    length = _of_template(F.col("template"), sizes)
    full = merged.where(base & (F.bit_count("seen") == grams_in)).select(*key, F.col("diagonal").alias("start"), (F.col("diagonal") + length).alias("stop"))
    spans = merged.where(~base).groupBy(*key, "span").agg(F.bit_or("seen").alias("seen"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    share = F.bit_count("seen") / grams_in
    needed = _of_template(F.col("template"), [1.0 if n <= SHORT else VOTES for n in sizes])
    loose = spans.where(share >= needed).select(*key, F.greatest(F.lit(0), F.col("low")).alias("start"), (F.col("high") + length).alias("stop"))
    return full.unionByName(loose)


def _in_order(words: Column, template: Column) -> Column:
    """How many words of a span stand in the template's order; up to JUMP words of the template may be left out at once."""

    def step(at: Column, word: Column) -> Column:
        ahead = F.array_position(F.slice(template, at["next"] + 1, JUMP + 1), word).cast("int")
        return F.struct((at["next"] + ahead).alias("next"), (at["same"] + (ahead > 0).cast("int")).alias("same"))

    return F.aggregate(words, F.struct(F.lit(0).alias("next"), F.lit(0).alias("same")), step, lambda at: at["same"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of `docs` (doc_id, text).

    n_base counts the places where a phrase of PHRASES stands, first_word and last_word are the smallest and largest
    start of those, in words from 0. base_labels has their labels, labels those of verified NOTICES as well; both
    are distinct, sorted and joined by commas. score is 1 with a phrase, else the best agreement of a notice: twice the
    words that stand in the notice's order over the words of notice and span, which is 1 only for what is verbatim.

    Null and empty texts have no words and no labels (empty strings), null places and score 0; so have texts without a
    license. Repeated rows give repeated results; rows that share a doc_id are judged each by its own
    text; a null doc_id stays null. Other columns are ignored, an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = staged(find_spans(docs), "license-spans")
    own = spans.groupBy(F.col("doc_id").alias("of"), F.col("digest").alias("its")).agg(F.collect_list(F.struct("template", "start", "stop")).alias("spans"))
    lists = small_side(staged(own, "license-lists"), 48, F.size("spans") * 16)
    words = docs.select("doc_id", F.xxhash64("text").alias("digest"), words_of(F.col("text")).alias("words"))
    joined = words.join(lists, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("its")), "left")
    template_words = lambda s: _of_template(s["template"], [w for _, w, _ in TEMPLATES])
    is_base = lambda s: _of_template(s["template"], [b for _, _, b in TEMPLATES])
    stands = lambda s: F.slice(F.col("words"), s["start"] + 1, s["stop"] - s["start"])
    exact = F.filter("spans", lambda s: is_base(s) & (stands(s) == template_words(s)))
    judged = F.transform(F.filter("spans", lambda s: ~is_base(s)), lambda s: F.struct(s["template"].alias("template"), _in_order(stands(s), template_words(s)).alias("same"), F.size(stands(s)).alias("long"), F.size(template_words(s)).alias("of")))
    loose = F.filter(judged, lambda s: s["same"] >= s["of"] * WORDS)
    label = lambda s: _of_template(s["template"], [x for x, _, _ in TEMPLATES])
    found = joined.select("doc_id", F.size("words").cast("long").alias("n_words"), exact.alias("exact"), loose.alias("loose"))
    none = F.array().cast("array<string>")
    base, own = (F.coalesce(F.transform(c, label), none) for c in ("exact", "loose"))
    starts = F.transform("exact", lambda s: s["start"].cast("long"))
    score = F.when(F.size("exact") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("loose", lambda s: 2.0 * s["same"] / (s["long"] + s["of"]))), F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.when(F.size("exact") > 0, F.size("exact")), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(base))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, own))).alias("labels"),
        score.alias("score"),
    )
