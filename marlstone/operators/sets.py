"""Set operations on keyed tables: unions, upserts, merges that keep good values, differences, pending work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tagged_union(parts: Sequence[tuple[str, DataFrame]], tag: str) -> DataFrame:
    """Tables of different columns as one, each row with its table's tag."""
    out = None
    for name, frame in parts:
        frame = frame.withColumn(tag, F.lit(name))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows without those whose key is in new, and all new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_only(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows as `kept`, new ones with new keys as `inserted`, the other new ones as `conflict`, in column `how`."""
    there = old.select(*keys).distinct().withColumn("_there", F.lit(True))
    came = new.join(there, list(keys), "left").withColumn("how", F.when(F.col("_there"), "conflict").otherwise("inserted")).drop("_there")
    return old.withColumn("how", F.lit("kept")).unionByName(came)


def last_good(old: DataFrame, new: DataFrame, key: str, value: str, good: str, reviewed: str) -> DataFrame:
    """(key, value, source): the old value where it is good and the new one is bad or the old was reviewed, else the new."""
    o = old.select(key, F.col(value).alias("_ov"), F.col(good).alias("_og"), F.col(reviewed).alias("_or"), F.lit(True).alias("_o"))
    n = new.select(key, F.col(value).alias("_nv"), F.col(good).alias("_ng"), F.lit(True).alias("_n"))
    true = lambda c: F.coalesce(c, F.lit(False))
    keep = true(F.col("_o")) & (~true(F.col("_n")) | (true(F.col("_og")) & (~true(F.col("_ng")) | true(F.col("_or")))))
    return o.join(n, key, "full").select(key, F.when(keep, F.col("_ov")).otherwise(F.col("_nv")).alias(value), F.when(keep, "old").otherwise("new").alias("source"))


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def set_parts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(part, n) of `both`, `left_only` and `right_only`: distinct keys, by one aggregate over the union."""
    each = a.select(key, F.lit(1).alias("_s")).unionByName(b.select(key, F.lit(2).alias("_s"))).groupBy(key).agg(F.bit_or("_s").alias("_s"))
    one = each.agg(*(F.count_if(F.col("_s") == s).alias(name) for s, name in ((3, "both"), (1, "left_only"), (2, "right_only"))))
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("part"), F.col(name).alias("n")) for name in ("both", "left_only", "right_only")))))


def pending(universe: DataFrame, done: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """The universe without the done and the excluded."""
    gone = done.select(key).unionByName(excluded.select(key)).distinct()
    return universe.join(gone, key, "left_anti")


def partition_audit(sets: Sequence[tuple[str, DataFrame]], universe: DataFrame, key: str) -> DataFrame:
    """(key, sets, n, status): OK for a key of the universe in just one set, OVERLAP, LEFTOVER, or STRANGER."""
    tagged = None
    for name, frame in [*sets, ("", universe)]:
        frame = frame.select(key, F.lit(name).alias("_s"))
        tagged = frame if tagged is None else tagged.unionByName(frame)
    per = tagged.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("_s") != "", F.col("_s")))).alias("_in"), F.bool_or(F.col("_s") == "").alias("_u"))
    status = F.when(~F.col("_u"), "STRANGER").when(F.size("_in") == 0, "LEFTOVER").when(F.size("_in") > 1, "OVERLAP").otherwise("OK")
    return per.select(key, F.concat_ws("+", "_in").alias("sets"), F.size("_in").alias("n"), status.alias("status"))
