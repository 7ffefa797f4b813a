"""Exact ranks and quantiles that no single task has to sort or hold.

Ranks: the distinct values, with their counts, are dealt by range; each range learns how many rows lie before it from one
small table of range totals, and counts on from there. Quantiles: a sketch says between which two values a quantile must
lie; rows below are counted, and only those in between are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import small_side, written

#: A sketch is right to one part in ACCURACY of a group's rows; groups of up to ten times as many rows need none.
ACCURACY = 10_000


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right, strict=True)), F.lit(True))


def exact_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], shares: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(keys, a column of `columns` each): an array of the interpolated quantiles `shares` of each group.

    Nulls and NaN are left out; a group without values in a column has null there. Null keys are a group. Results are
    those of percentile(); groups of up to 10 * `accuracy` rows are looked at whole, of larger ones some 4 rows in
    `accuracy` about each quantile.
    """
    keys, shares = list(keys), [float(p) for p in shares]
    value = F.nanvl(F.col("_pair._x"), F.lit(None).cast("double"))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_x")) for c in columns)))
    long = df.select(*keys, pairs.alias("_pair")).select(*keys, F.col("_pair._c").alias("_c"), value.alias("_x")).where("_x is not null")
    edge = 2.0 / accuracy
    near = [min(1.0, max(0.0, p + s * edge)) for p in shares for s in (-1, 1)]
    sketch = long.groupBy(*keys, "_c").agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.percentile_approx("_x", near, accuracy).alias("_near"))
    place = [F.lit(p) * (F.col("_n") - 1) for p in shares]
    whole = lambda i, s: (F.col("_n") <= 10 * accuracy) | F.lit(not 0 < shares[i] + s * edge < 1)
    bounds = [
        F.struct(
            F.lit(i).alias("_p"),
            F.floor(place[i]).alias("_k"),
            place[i].alias("_place"),
            F.when(whole(i, -1), F.col("_lo")).otherwise(F.get("_near", F.lit(2 * i))).alias("_from"),
            F.when(whole(i, 1), F.col("_hi")).otherwise(F.get("_near", F.lit(2 * i + 1))).alias("_to"),
        )
        for i in range(len(shares))
    ]
    told = sketch.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_c").alias("_of"), F.array(*bounds).alias("_bounds"))
    own = _same([*map(F.col, keys), F.col("_c")], [*(F.col(f"_k_{k}") for k in keys), F.col("_of")])
    # the shuffled sketches are far larger than what they tell, which adaptive execution would judge them by
    met = long.join(small_side(written(told, "quantile-bounds"), 64 + 64 * len(shares)), own)
    # a value below the bound counts as null: such rows are one row of each task
    looked = F.explode(F.transform(F.filter("_bounds", lambda b: F.col("_x") <= b["_to"]), lambda b: F.struct(b["_p"].alias("_p"), b["_k"].alias("_k"), b["_place"].alias("_place"), F.when(F.col("_x") >= b["_from"], F.col("_x")).alias("_v"))))
    counts = met.select(*keys, "_c", looked.alias("_b")).groupBy(*keys, "_c", "_b").agg(F.count("*").alias("_m"))
    counts = counts.select(*keys, "_c", "_b.*", "_m")
    upto = F.sum("_m").over(Window.partitionBy(*keys, "_c", "_p").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda more: F.min(F.when(F.col("_upto") > F.col("_k") + more, F.col("_v")))
    found = counts.withColumn("_upto", upto).groupBy(*keys, "_c", "_p").agg(at(0).alias("_a"), at(1).alias("_z"), F.first("_place").alias("_place"), F.first("_k").alias("_k"))
    part = F.col("_place") - F.col("_k")
    between = F.when((part == 0) | (F.col("_a") == F.col("_z")), F.col("_a")).otherwise((F.col("_k") + 1 - F.col("_place")) * F.col("_a") + part * F.col("_z"))
    arrays = [F.max(F.when(F.col("_c") == c, F.col("_q"))).alias(c) for c in columns]
    per = found.groupBy(*keys, "_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", between.alias("_y")))), lambda x: x["_y"]).alias("_q"))
    return per.groupBy(*keys).agg(*arrays)


def value_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, _c, _x, _n): how many rows of a group have which value in which of the columns, without nulls and NaN."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_x")) for c in columns)))
    return df.select(*keys, pairs.alias("_pair")).select(*keys, "_pair.*").where("_x is not null and not isnan(_x)").groupBy(*keys, "_c", "_x").agg(F.count("*").alias("_n"))


def counted_quantiles(counts: DataFrame, keys: Sequence[str], columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """exact_quantiles() of the rows behind value_counts(), whose counts of a group and value add up; null keys are a group."""
    keys, named = list(keys), [*keys, "_c"]
    at = value_ranks(counts, "_x", named, weight="_n")
    place = [F.lit(float(p)) * (F.col("rows") - 1) for p in shares]
    here = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("ties")), F.col("_x")))
    per = at.groupBy(*named).agg(*(here(F.floor(x) + more).alias(f"_{name}{i}") for i, x in enumerate(place) for more, name in enumerate("az")), F.first("rows").alias("rows"))

    def between(i: int) -> Column:
        a, z, k = F.col(f"_a{i}"), F.col(f"_z{i}"), F.floor(place[i])
        return F.when((place[i] == k) | (a == z), a).otherwise((k + 1 - place[i]) * a + (place[i] - k) * z)

    per = per.select(*named, F.array(*map(between, range(len(shares)))).alias("_q"))
    return per.groupBy(*keys).agg(*(F.max(F.when(F.col("_c") == c, F.col("_q"))).alias(c) for c in columns))


def value_ranks(df: DataFrame, column: str, groups: Sequence[str] = (), descending: bool = False, weight: str | None = None) -> DataFrame:
    """(groups, column, before, ties, rows): of each distinct value, how many rows of its group lie before it and have it.

    A row counts as many times as its `weight` says. Nulls are left out of all three; there is a row for each value, so that rows with many ties stay where they are.
    Values are dealt by range of (groups, column), whatever the groups' sizes.
    """
    groups = list(groups)
    spark = df.sparkSession
    per = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg((F.sum(weight) if weight else F.count("*")).alias("ties"))
    order = [*(F.col(g).asc() for g in groups), F.col(column).desc() if descending else F.col(column).asc()]
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(per.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranks")
    # a row of each range that a group has rows in; a range's own rows are summed up within it
    totals = dealt.groupBy("_range", *groups).agg(F.sum("ties").alias("_sum"))
    ahead = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"_ahead": F.coalesce(F.sum("_sum").over(ahead), F.lit(0)), "rows": F.sum("_sum").over(Window.partitionBy(*groups))}).drop("_sum")
    totals = totals.select(F.col("_range").alias("_of"), *(F.col(g).alias(f"_k_{g}") for g in groups), "_ahead", "rows")
    own = (F.col("_range") == F.col("_of")) & _same([F.col(g) for g in groups], [F.col(f"_k_{g}") for g in groups])
    within = F.coalesce(F.sum("ties").over(Window.partitionBy("_range", *groups).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_within", within).join(totals, own).select(*groups, column, (F.col("_ahead") + F.col("_within")).alias("before"), "ties", "rows")


def ranked(df: DataFrame, column: str, groups: Sequence[str] = (), descending: bool = False, **names: str) -> DataFrame:
    """df with ranks of a column under the names given.

    `first`: 1 + rows before (ties share the smallest rank); `mean`: ties at their mean rank; `share`: the mean rank as
    percent of the non-null rows; `rows`: the number of those. Null values get nulls, but for `rows`.
    """
    groups = list(groups)
    at = value_ranks(df, column, groups, descending)
    at = at.select(*(F.col(g).alias(f"_k_{g}") for g in groups), F.col(column).alias("_v"), "before", "ties", F.col("rows").alias("_rows"))
    joined = df.join(at, _same([F.col(g) for g in groups], [F.col(f"_k_{g}") for g in groups]) & (F.col(column) == F.col("_v")), "left")
    mean = F.col("before") + (F.col("ties") + 1) / F.lit(2.0)
    told = {"first": F.col("before") + 1, "mean": mean, "share": mean / F.col("_rows") * 100, "rows": F.col("_rows")}
    return joined.select(*(F.col(c) for c in df.columns), *(told[k].alias(name) for k, name in names.items()))
