"""Registration of queries, and the views of the supplied tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: SQL of the views below, for use after WITH.
TRADES = """t AS (SELECT l_suppkey AS entity, l_partkey AS part, l_orderkey AS deal, CAST(l_shipdate AS DATE) AS deal_date, l_quantity AS area,
  l_extendedprice AS amount, l_extendedprice / l_quantity AS unit, l_discount AS discount, l_returnflag AS flag FROM lineitem)"""
#: One row for each supplier: size, median price, score and group.
ENTITIES = f"""{TRADES}, e AS (SELECT s.s_suppkey AS entity, s.s_nationkey AS grp, s.s_acctbal AS score, COUNT(t.entity) AS deals, MEDIAN(t.unit) AS price,
  SUM(t.area) AS area FROM supplier s LEFT JOIN t ON t.entity = s.s_suppkey GROUP BY 1, 2, 3)"""


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades: a supplier is the entity traded, a quantity its area."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity"),
        F.col("l_partkey").alias("part"),
        F.col("l_orderkey").alias("deal"),
        F.to_date("l_shipdate").alias("deal_date"),
        F.col("l_quantity").alias("area"),
        F.col("l_extendedprice").alias("amount"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
        F.col("l_discount").alias("discount"),
        F.col("l_returnflag").alias("flag"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the number, median price and area of their trades."""
    per = trades(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("deals"), F.percentile("unit", 0.5).alias("price"), F.sum("area").alias("area"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("score"))
    return own.join(per, "entity", "left").withColumn("deals", F.coalesce("deals", F.lit(0)))
