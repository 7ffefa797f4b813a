"""Guards: checks of schema, keys, domains, sums and coverage. Those that raise run one aggregate; the others give tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GuardError(ValueError):
    """A table that breaks what an operator relies on."""


def require_columns(df: DataFrame, columns: Sequence[str], exact: bool = False) -> list[str]:
    """Raises unless the columns are there; gives the extra ones, which `exact` forbids."""
    missing = [c for c in columns if c not in df.columns]
    extra = [c for c in df.columns if c not in columns]
    if missing or exact and extra:
        raise GuardError(f"missing columns {missing}, extra columns {extra}")
    return extra


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, count) of the keys that occur more than once."""
    return df.groupBy(*keys).count().where("count > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, if its keys are unique and not null; else raises with an example."""
    for row in repeated_keys(df, keys).limit(1).collect():
        raise GuardError(f"repeated key {row.asDict()}")
    for row in df.where(" or ".join(f"`{k}` is null" for k in keys)).limit(1).collect():
        raise GuardError(f"null key {row.asDict()}")
    return df


def issues(df: DataFrame, key: str, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, code, detail): a row for each check that a row breaks; conditions state the violation."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"))) for code, c in checks)))
    return df.select(key, F.inline(found))


def in_scope(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: whether each condition holds for all rows; null counts as no."""
    return df.agg(*(F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True)).alias(name) for name, c in conditions.items()))


def reconciled(df: DataFrame, parts: Sequence[str], total: str, tolerance: float = 0.0) -> DataFrame:
    """df with the difference of a sum of parts to its total, and whether it is within the tolerance."""
    gap = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0)) - F.col(total)
    return df.withColumn("difference", gap).withColumn("reconciled", F.coalesce(F.abs(gap) <= tolerance, F.lit(False)))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are in one table only, and whether none is."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    both = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only")).withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def no_leakage(train: DataFrame, test: DataFrame, when: str) -> DataFrame:
    """One row: the last training and first test time, and whether the first lies before the second."""
    return train.agg(F.max(when).alias("last_train")).crossJoin(test.agg(F.min(when).alias("first_test"))).withColumn("ok", F.col("last_train") < F.col("first_test"))


def equal_within(one: DataFrame, two: DataFrame, key: str, columns: Mapping[str, float]) -> DataFrame:
    """A row for each column: whether both tables agree on it for all keys, within its tolerance; two nulls agree."""
    a = one.select(key, *(F.col(c).alias(f"_a_{c}") for c in columns), F.lit(True).alias("_in_a"))
    b = two.select(key, *(F.col(c).alias(f"_b_{c}") for c in columns), F.lit(True).alias("_in_b"))
    both = a.join(b, key, "full")

    def same(c: str, tolerance: float) -> Column:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        return F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())

    one_row = both.agg(*(F.coalesce(F.bool_and(same(c, t)), F.lit(True)).alias(c) for c, t in columns.items()))
    return one_row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("equal")) for c in columns))))


def reproduced(metrics: DataFrame, snapshot: DataFrame, tolerances: Mapping[str, float]) -> DataFrame:
    """(metric, value, frozen, ok) of metrics (metric, value) against frozen ones; a metric without a partner fails."""
    limit = F.coalesce(F.create_map(*(F.lit(x) for kv in tolerances.items() for x in kv))[F.col("metric")], F.lit(0.0)) if tolerances else F.lit(0.0)
    both = metrics.select("metric", "value").join(snapshot.select("metric", F.col("value").alias("frozen")), "metric", "full")
    return both.withColumn("ok", F.coalesce(F.abs(F.col("value") - F.col("frozen")) <= limit, F.lit(False)))


def check_table(checks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(check, passed, detail) from one-row frames (passed, detail)."""
    out = None
    for name, frame in checks:
        row = frame.select(F.lit(name).alias("check"), "passed", F.col("detail").cast("string").alias("detail"))
        out = row if out is None else out.unionByName(row)
    return out


def checkpoints(df: DataFrame, key: str, checks: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(key, step, name, passed, detail, all_passed): named checks of each row in order."""
    made = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.coalesce(c, F.lit(False)).alias("passed"), detail.cast("string").alias("detail")) for i, (name, c, detail) in enumerate(checks, 1)))
    return df.select(key, made.alias("_m")).withColumn("all_passed", F.forall("_m", lambda m: m["passed"])).select(key, F.inline("_m"), "all_passed")
