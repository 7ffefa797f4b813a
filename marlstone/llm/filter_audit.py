"""Filter interaction audit by failing-id relations.

Each filter has a written table of the ids that fail it. What a prefix of filters leaves is the rows' left-anti join with
its tables, one after the other; who fails a filter at all is their left-semi join with its table. Both are counted by
part of the table, with the labels. An order's steps read these counts at the prefix before and the prefix after, so
that 120 orders of five filters take 32 sets of survivors and no further pass.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import scratch_dir, small_side, staged

FILTERS = "ABCDE"
#: A text is hot if it is more than one row in HOT_SHARE; so there are fewer than HOT_SHARE hot texts.
HOT_SHARE = 10_000
_AUDIT = "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"


def _rules(text: Column) -> dict[str, Column]:
    """What fails the filters that judge a text by itself."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def _later_copies(rows: DataFrame) -> DataFrame:
    """(row) of each row of `rows` (row, doc_id, digest) whose digest a smaller doc_id has too."""
    per = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    copies = staged(per.where("first < last").drop("last"), "audit-copies")
    is_hot = F.col("n") * HOT_SHARE > rows.count()
    # fewer than HOT_SHARE rows of 50 bytes: rows of hot texts stay where they are, all others meet by digest
    hot = F.broadcast(copies.where(is_hot))
    named = rows.where("doc_id is not null")
    cold = named.join(hot.select("digest"), "digest", "left_anti").join(copies.where(~is_hot), "digest")
    return named.join(hot, "digest").unionByName(cold).where("doc_id > first").select("row")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, part, good, toxic) of `rows`; a document is good, or toxic, if any of its labels says so."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    said = small_side(staged(said.where("of is not null and (good or toxic)"), "audit-labels"), 24)
    flags = [F.coalesce(c, F.lit(False)).cast("long").alias(c) for c in ("good", "toxic")]
    with_id = rows.where("doc_id is not null").join(said, F.col("doc_id") == F.col("of"), "left").select("row", "part", *flags)
    return with_id.unionByName(rows.where("doc_id is null").select("row", "part", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic")))


def audit_orders(ids: DataFrame, failing: DataFrame, filters: str) -> DataFrame:
    """Counts of every order of a few `filters`, of one letter each, applied to `ids` (row, part, good, toxic).

    `failing` (row, filter) has a row for each filter that a row fails; it should be a written table, partitioned by
    filter. Gives (part, filter_order, step) with the columns of audit_filters(). Work grows with 2 ** filters.
    """
    of = {f: failing.where(F.col("filter") == f).select("row") for f in filters}
    bit = {f: 1 << i for i, f in enumerate(filters)}
    counted = []
    for n in range(len(filters) + 1):
        for chosen in combinations(filters, n):
            left = ids
            for f in chosen:
                left = left.join(of[f], "row", "left_anti")
            counted.append(left.select(F.lit(sum(bit[f] for f in chosen)).alias("which"), "part", "good", "toxic"))
    for f in filters:  # who fails f at all stands below zero
        counted.append(ids.join(of[f], "row", "left_semi").select(F.lit(-bit[f]).alias("which"), "part", "good", "toxic"))
    together = counted[0]
    for more in counted[1:]:
        together = together.unionByName(more)
    counts = together.groupBy("part", "which").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    per = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("which", F.struct("n", "good", "toxic")))).alias("at"))

    def mask(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(f)), bit[f]).otherwise(0) for f in filters), F.lit(0))

    def at(which: Column, what: str) -> Column:
        return F.coalesce(F.element_at("at", which)[what], F.lit(0).cast("long"))

    orders = ",".join("".join(p) for p in permutations(filters))
    steps = per.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("before", mask(F.expr("left(filter_order, step - 1)"))).withColumn("after", mask(F.expr("left(filter_order, step)")))
    everything = sum(bit.values())
    own = F.col("after") - F.col("before")
    steps = steps.select(
        *("part", "filter_order", "step", "filter"),
        at(F.col("after"), "n").alias("kept"),
        (at(F.col("before"), "n") - at(F.col("after"), "n")).alias("removed"),
        at(-own, "n").alias("failing"),
        (at(everything - own, "n") - at(F.lit(everything), "n")).alias("unique_fails"),
        (at(F.col("before"), "good") - at(F.col("after"), "good")).alias("good_lost"),
        (at(F.col("before"), "toxic") - at(F.col("after"), "toxic")).alias("toxic_lost"),
    ).withColumn("redundant", F.col("failing") - F.col("removed"))
    # a window over a part's orders: 120 rows of a filter, however many documents there are
    steps = steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    return steps.select("part", "filter_order", "step", *_AUDIT)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters removes from `docs` (doc_id, text, lang), at each step of each of their 120 orders.

    A document fails A with under 100 words, B if under 80 % of its words are distinct, C if over 10 % of its code points
    are A-Z, D if it holds any of #$%&*|, E if a smaller doc_id has the same text. Gives, for each part (value of lang),
    filter_order and step: kept (after the step), removed (at it), redundant (failing its filter but removed before),
    unique_fails (failing its filter only), good_lost and toxic_lost (removed at it with quality 1, toxic 1 in `labels`)
    and shapley (removed by its filter, summed over all orders).

    A null text is empty: it fails A, and E if an empty text has a smaller id. A null lang is the part ''. A row without
    doc_id has no labels, fails no E and makes none fail it; rows that share an id are judged apart, and equal texts of
    one id don't fail E. A document with several rows of labels is good, or toxic, if one of them says so. Other columns
    are ignored; a table without documents gives no rows, one without labels no losses.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rules = _rules(text)
    rows = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            *(rule.alias(name) for name, rule in rules.items()),
        ),
        "audit-rows",
    )
    own = F.explode(F.array_compact(F.array(*(F.when(F.col(name), F.lit(name)) for name in rules))))
    failing = rows.select("row", own.alias("filter")).unionByName(_later_copies(rows).withColumn("filter", F.lit("E")))
    path = scratch_dir(docs.sparkSession, "audit-failing")
    failing.write.partitionBy("filter").parquet(path)
    failing = docs.sparkSession.read.schema("row long, filter string").parquet(path)
    return audit_orders(staged(_labelled(rows, labels), "audit-ids"), failing, FILTERS)
