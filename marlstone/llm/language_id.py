"""Language identification by compression.

Each language has two zstandard dictionaries of raw content, taken from labelled documents. A text is cut into
segments, so that it is judged by the dictionaries and not by its own repetition, and each segment is compressed with
one dictionary of each language, in turn; a text of one segment is compressed with all of them. The language whose
dictionaries leave the fewest bytes is chosen. The margin to the runner-up,
as a share of its bytes, is the score; a narrow margin is a rejection.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import small_side, staged
from ._words import LOWER_TABLE

#: Labelled documents that each dictionary is made of, dictionaries of a language, and bytes of a dictionary.
FIT_DOCS, DICTIONARIES, DICTIONARY_BYTES = 48, 2, 96 << 10
#: Lengths in characters of the documents that the sample prefers.
FIT_CHARS = (400, 6000)
#: Bytes of a segment, and zstandard's level.
SEGMENT, LEVEL = 400, 6
#: Scores below this are rejections.
MARGIN = 0.004
UNKNOWN = "und"

_plain = bytes.maketrans(bytes(range(0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)), b" " * (0x41 + 6 + 5))


def letters_only(text: str) -> bytes:
    """Lower-cased (A-Z) bytes with runs of ASCII other than letters as one space."""
    return b" ".join(text.encode().translate(_plain).translate(LOWER_TABLE).split())


def _kept_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (lang, place, text) with the part of the text's letters that a dictionary may keep."""
    for batch in batches:
        letters = [letters_only(text)[-DICTIONARY_BYTES:] for text in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("lang"), batch.column("place"), pa.array(letters, pa.binary())], ["lang", "place", "letters"])


def fit(labelled: DataFrame) -> dict[str, list[bytes]]:
    """The dictionaries of each language of `labelled` (doc_id, text, lang), from a bounded sample of it.

    The sample has up to FIT_DOCS * DICTIONARIES whole documents of each language, those first in the order of a hash
    of doc_id; documents of FIT_CHARS characters go before others. A dictionary keeps the last DICTIONARY_BYTES bytes of
    its documents' letters. Languages come in the order of their frequency.

    Documents are chosen by their ids and hashes first, and only the letters of those travel, cut to a dictionary's bytes.
    """
    key = ["doc_id", "lang", "digest"]
    rows = labelled.where("text is not null and lang is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("text").cast("string")).alias("digest"), F.col("text").cast("string").alias("text")
    )
    often = {row.lang: row.n for row in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    fits = F.length("text").between(*FIT_CHARS)
    order = Window.partitionBy("lang").orderBy(F.col("fits").desc(), F.xxhash64("doc_id"), "doc_id", "digest")
    places = rows.select(*key, fits.alias("fits")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIT_DOCS * DICTIONARIES)
    chosen = staged(places.groupBy(*key).agg(F.min("place").alias("place")), "language-sample").select(*(F.col(c).alias(f"its_{c}") for c in key), "place")
    same = F.col("doc_id").eqNullSafe(F.col("its_doc_id")) & (F.col("digest") == F.col("its_digest")) & (F.col("lang") == F.col("its_lang"))
    own = rows.join(small_side(chosen, 64), same).select("lang", "place", "text").mapInArrow(_kept_letters, "lang string, place int, letters binary")
    texts = own.groupBy("lang", "place").agg(F.any_value("letters").alias("letters"))
    found: dict[str, list[list[bytes]]] = defaultdict(lambda: [[] for _ in range(DICTIONARIES)])
    for row in texts.sort("lang", "place").toLocalIterator():
        found[row.lang][row.place % DICTIONARIES].append(bytes(row.letters))
    return {lang: [b" ".join(x)[-DICTIONARY_BYTES:] for x in parts] for lang, parts in sorted(found.items(), key=lambda x: (-often[x[0]], x[0]))}


def _classify(model, filtering: bool = False):
    """mapInArrow function: (doc_id, text) to (doc_id, lang_pred, score); or the accepted rows with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, compressors = [], []
        for lang, contents in model.value.items():
            langs.append(lang)
            compressors.append([])
            for content in contents:
                own = None
                if len(content) >= 8:  # less is no dictionary
                    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    own.precompute_compress(level=LEVEL)
                compressors[-1].append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False).compress)
        for batch in batches:
            pred, score = [], []
            for text in batch.column("text").to_pylist():
                if text is None or not langs or not any(map(str.isalpha, text)):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                plain = b" " + letters_only(text) + b" "
                parts = [plain[i : i + SEGMENT] for i in range(0, len(plain), SEGMENT)]
                use = [(j % DICTIONARIES, x) for j, x in enumerate(parts)] if len(parts) > 1 else [(j, plain) for j in range(DICTIONARIES)]
                sizes = sorted((sum(len(own[j](x)) for j, x in use), place) for place, own in enumerate(compressors))
                pred.append(langs[sizes[0][1]])
                score.append(1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0])
            if filtering:
                yield batch.filter(pa.array([p != UNKNOWN and s >= MARGIN for p, s in zip(pred, score, strict=True)], pa.bool_()))
                continue
            yield pa.record_batch([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of each row of `docs` (doc_id long, text string), learned from `labelled`.

    score is the margin, from 0 to 1; accepted says that it is at least MARGIN. Ties go to the most frequent language,
    then to the one that sorts first, and are rejected, as their margin is 0. A null text, a text without letters, and any text if nothing is
    labelled, gets `und`, score 0, and is rejected. With one language learned the score is 1. Repeated rows give repeated
    results, a null doc_id stays null, other columns are ignored, an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled))  # a few dictionaries of fixed size a language
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = plain.mapInArrow(_classify(model), "doc_id long, lang_pred string, score double")
    return found.withColumn("accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MARGIN))


def accepted_documents(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that identify_languages() accepts.

    Null, empty and letterless texts and ties are rejected, repeated rows share one fate, columns of any name are kept
    as they are; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled))
    return docs.mapInArrow(_classify(model, filtering=True), docs.schema)


def held_out(doc_id) -> Column:
    """The fold that is never learned from: crc32 of doc_id as text leaves 2 when divided by 4. False for null."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))
