"""Mixing sources to target weights by pivotal dependent rounding.

A source's target, as a share of its size, gives each of its documents a number of copies with a fractional part.
Pairs of documents exchange the words of their fractional copies at random until one of the two has none or a whole
copy; expectations and the source's total of words are kept at every step. Documents are dealt to leaves of bounded size,
so a source that holds a third of all rows is rounded in many tasks; each leaf hands on one unfinished document, and those
are paired again, in a tree, until one is left for each source, which is rounded to the nearer copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fresh, partitions_for, small_side, staged
from .near_dup import grouped

#: Documents of one leaf, and unfinished documents that are paired by one inner node.
LEAF, FAN_IN = 20_000, 64
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
_CARRIED = "row long, digest long, doc_id long, source string, src long, size long, mass double, whole long, node long, done boolean"


def source_targets(sizes: DataFrame, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(src, source, source_size, docs, target) of each source of `sizes` (source, size), in written form.

    Sources stand in the order of code points, null last, and weigh WEIGHTS in turn. They share `total_share` of all
    words by weight; none gets over `most` times its own words, and what is over is shared again by the others.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # one row for each source; the order of the names is all that passes through one task
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS) + 1).cast("int"))
    per = staged(per.withColumn("src", place.cast("long")).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)), "mix-sources")
    level, full = 0.0, -1
    while True:  # a few aggregates over the table of sources
        is_full = F.col("weight") * F.lit(level) >= F.col("cap") if full >= 0 else F.lit(False)
        row = per.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(~is_full, F.col("weight")).otherwise(0.0)).alias("open"),
            F.sum(is_full.cast("long")).alias("full"),
        ).first()
        if row.words is None or not row.open or row.full == full:
            break
        full, level = row.full, (row.words * total_share - row.capped) / row.open
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return per.select("src", "source", "source_size", "docs", target.alias("target"))


def _round(last: bool):
    """mapInArrow function over nodes, sorted by (src, node, size from the largest, doc_id, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["src", "node"]):
            size = group.column("size").to_numpy().astype(np.float64)
            mass = group.column("mass").to_numpy().copy()
            src, node = group.column("src")[0].as_py(), group.column("node")[0].as_py()
            draw = np.random.Generator(np.random.PCG64([src, node, len(size), int(size.sum())])).random(len(size))
            done = np.ones(len(size), bool)
            held = -1
            for i in range(len(size)):
                if mass[i] <= 0 or mass[i] >= size[i]:
                    continue
                if held < 0:
                    held = i
                    continue
                up, down = min(size[held] - mass[held], mass[i]), min(mass[held], size[i] - mass[i])
                move = up if draw[i] * (up + down) < down else -down
                mass[held] += move
                mass[i] -= move
                for j in (held, i):  # sums of floats: what is next to whole is whole
                    if mass[j] < 1e-6:
                        mass[j] = 0.0
                    elif size[j] - mass[j] < 1e-6:
                        mass[j] = size[j]
                open_ = [j for j in (held, i) if 0 < mass[j] < size[j]]
                held = open_[0] if open_ else -1
            if held >= 0:
                if last:
                    mass[held] = size[held] if 2 * mass[held] >= size[held] else 0.0
                else:
                    done[held] = False
            names = group.schema.names
            cols = [pa.array(mass) if c == "mass" else pa.array(done) if c == "done" else group.column(c).combine_chunks() for c in names]
            yield pa.record_batch(cols, names)

    return run


def mix_sources(docs: DataFrame, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each row of `docs` (doc_id, text, source).

    size counts runs of text without ASCII white space; source_targets() says what target is. copies is the number of
    times that the mix takes the document, taken that times its size. A source's taken words miss its target by half a
    document at most. Runs over equal rows give equal results.

    A null text has size 0; documents of size 0 are taken no times. A null source is a source of its own, the last.
    Repeated rows are rounded apart, a null doc_id like any other value. A source without words has target 0. Other
    columns are ignored; an empty table gives no rows.
    """
    none = F.lit(None).cast("long")
    return _mixed(docs, none, none, total_share, most).drop("row")


def _mixed(docs: DataFrame, row: Column, digest: Column, total_share: float, most: float) -> DataFrame:
    """mix_sources() with `row` of each row; of rows with the same doc_id and size, `digest` says which come first."""
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sizes = staged(docs.select(row.alias("row"), digest.alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size")), "mix-sizes")
    sources = source_targets(sizes, total_share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = sources.select("src", F.col("source").alias("of"), "docs", rate.alias("rate"))
    dealt = (
        sizes.join(small_side(named, 64), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("long"))
        .withColumn("mass", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")) * F.col("size"))
        .withColumn("node", F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("docs") / LEAF)))
        .select("row", "digest", "doc_id", "source", "src", "size", "mass", "whole", "node", F.lit(False).alias("done"))
    )
    most_docs = sources.agg(F.max("docs")).first()[0] or 0
    nodes, finished, n = -(-most_docs // LEAF), [], partitions_for(spark)
    while True:
        last = nodes <= 1
        rounded = (
            dealt.repartition(n, "src", "node")
            .sortWithinPartitions("src", "node", F.col("size").desc(), F.col("doc_id").asc_nulls_last(), "digest")
            .mapInArrow(_round(last), _CARRIED)
        )
        rounded = staged(rounded, "mix-round")
        finished.append(rounded.where("done"))
        if last:
            break
        dealt = rounded.where("not done").withColumn("node", F.floor(F.col("node") / FAN_IN))
        nodes = -(-nodes // FAN_IN)
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    totals = sources.select(F.col("src").alias("its"), "source_size", "target")
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("mass") > 0).cast("long")).otherwise(F.lit(0))
    out = out.join(small_side(totals, 40), F.col("src") == F.col("its")).withColumn("copies", copies.cast("long"))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of `docs`, with all their columns, as often as mix_sources() takes them.

    Each row has its own copies, whether its doc_id is null, repeated or neither. Of rows with the same doc_id, source
    and size, those are taken that come first by a hash of their columns. A null or empty text has no words and is not
    taken; columns of any name are kept as they are; an empty table gives no rows.
    """
    row, copies, copy = fresh(docs, "row"), fresh(docs, "copies"), fresh(docs, "copy")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    digest = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    taken = _mixed(rows, F.col(row), digest, total_share, most).where("copies > 0")
    taken = staged(taken.select(F.col("row").alias(row), F.col("copies").cast("int").alias(copies)), "mix-copies")
    joined = rows.join(small_side(taken, 24), row)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))
