"""Helpers that the operators of this subpackage share: tables, shared scratch space, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in estimated bytes, that is handed to every executor. Beyond it joins shuffle.
BROADCAST_BYTES = 32 << 20

_own_scratch: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one where that is unset in local mode."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return _own_scratch[app]


def scratch_dir(spark: SparkSession, what: str) -> str:
    return f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """`df` written to the shared scratch folder and read again: its lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_dir(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int, more: Column | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if its rows stay under `limit` bytes; else as it is, so that joins shuffle.

    A row counts as `row_bytes` bytes, and `more` where values have any length. `df` should be a written table: it is
    read here.
    """
    size = df.agg(F.count("*") * row_bytes + (F.lit(0) if more is None else F.coalesce(F.sum(more), F.lit(0)))).first()[0]
    return F.broadcast(df) if size <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as make it differ from all columns of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
