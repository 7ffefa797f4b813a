"""Ranks and quantiles with explicit rules for ties and missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_statistics import exact_quantiles, ranked


def _by(groups: list[str] | None):
    return Window.partitionBy(*(groups or []))


def average_rank(column: str, groups: list[str] | None = None) -> Column:
    """Rank from 1 with ties at their mean; null stays null and is not counted."""
    order = _by(groups).orderBy(F.col(column).asc_nulls_last())
    peers = Window.partitionBy(*(groups or []), column)
    rank = F.rank().over(order) + (F.count("*").over(peers) - 1) / F.lit(2.0)
    return F.when(F.col(column).isNotNull(), rank)


def percentile_rank(column: str, groups: list[str] | None = None) -> Column:
    """average_rank() as a share of the non-null rows, times 100."""
    return average_rank(column, groups) / F.count(column).over(_by(groups)) * 100


def min_rank_desc(column: str, groups: list[str] | None = None) -> Column:
    """1 for the largest; ties share the smallest rank; null stays null."""
    order = _by(groups).orderBy(F.col(column).desc_nulls_last())
    return F.when(F.col(column).isNotNull(), F.rank().over(order))


def reverse_percentile(column: str) -> Column:
    """(n - rank) / max(n - 1, 1) * 100 of min_rank_desc()."""
    n = F.count(column).over(_by(None))
    return (n - min_rank_desc(column)) / F.greatest(n - 1, F.lit(1)) * 100


def quintile(column: str, groups: list[str] | None = None) -> Column:
    """1 to 5 by percentile_rank(), right-closed, the lowest edge included."""
    return F.greatest(F.lit(1), F.ceil(percentile_rank(column, groups) / 20)).cast("int")


def row_quantile(column: str, buckets: int, ties: str, groups: list[str] | None = None) -> Column:
    """Equal-width buckets of the row number in the order of (column, ties): greatest(1, ceil(buckets * (r - 1) / (n - 1)))."""
    r = F.row_number().over(_by(groups).orderBy(F.col(column).asc_nulls_last(), ties))
    n = F.count("*").over(_by(groups))
    return F.greatest(F.lit(1), F.ceil(F.lit(buckets) * (r - 1) / F.greatest(n - 1, F.lit(1)))).cast("int")


def with_row_quantile(df: DataFrame, column: str, buckets: int, ties: str, name: str) -> DataFrame:
    """df with row_quantile() over all rows, numbered in ranges: no task sorts them all."""
    of = df.withColumn("_order", F.struct(F.col(column).isNull(), F.col(column), F.col(ties)))
    out = ranked(of, "_order", first="_first", rows="_rows").drop("_order")
    bucket = F.greatest(F.lit(1), F.ceil(F.lit(buckets) * (F.col("_first") - 1) / F.greatest(F.col("_rows") - 1, F.lit(1)))).cast("int")
    return out.withColumn(name, bucket).drop("_first", "_rows")


def with_quantiles(df: DataFrame, column: str, **shares: float) -> DataFrame:
    """df with exact quantiles of a column, each under its name, joined as a single row; no buffer holds the column."""
    one = exact_quantiles(df, [], [column], list(shares.values())).select(*(F.get(column, F.lit(i)).alias(name) for i, name in enumerate(shares)))
    return df.join(F.broadcast(one), F.lit(True), "left")  # one row, or none without values


def winsorised(df: DataFrame, column: str, low: float, high: float, name: str) -> DataFrame:
    """df with the column clipped to its own quantiles."""
    out = with_quantiles(df, column, _low=low, _high=high)
    clipped = F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.col("_low")), F.col("_high")))
    return out.withColumn(name, clipped).drop("_low", "_high")


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in a total order."""
    ranked = df.withColumn("_place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("_place") <= n).drop("_place")


def latest_row(df: DataFrame, key: str, when: str, ties: str) -> DataFrame:
    """The last row of each key by time, ties by the largest `ties`: one aggregate over structs, no sort."""
    names = [c for c in df.columns if c != key]
    packed = df.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(when, ties)).alias("_last"))
    return packed.select(key, *(F.col("_last")[c].alias(c) for c in names))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null where a side doesn't vary, which corr() takes for a division by zero."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, rho, n): Pearson of average ranks over complete rows; null with fewer than 3 rows or 2 distinct values."""
    groups = groups or []
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = whole.withColumns({"_x": average_rank(x, groups), "_y": average_rank(y, groups)})
    enough = (F.count("*") >= 3) & (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    return ranked.groupBy(*groups).agg(F.when(enough, correlation("_x", "_y")).alias("rho"), F.count("*").alias("n"))
