"""Sinks: runs that become visible when complete, CSV and JSON results, content history, batches, releases."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import written
from .readers import manifest


def publish(df: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> str:
    """Writes a run folder, then points `folder`/current at it; readers see the old run until then."""
    run = f"{folder}/run-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*partition_by).parquet(run)
    df.sparkSession.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").json(f"{folder}/current")
    return run


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The run that `folder`/current points at."""
    return spark.read.parquet(spark.read.schema("run string").json(f"{folder}/current").first().run)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_metrics(spark: SparkSession, metrics: Mapping[str, object], path: str) -> None:
    """One JSON row of metrics."""
    spark.range(1).select(*(F.lit(v).alias(k) for k, v in metrics.items())).coalesce(1).write.mode("overwrite").json(path)


def archive(df: DataFrame, content: str, path: str) -> DataFrame:
    """Appends the rows whose content isn't in the archive yet, by its digest; gives what was added.

    Of rows with the same content the least by all columns is taken, so that a run that repeats picks the same; what is
    returned is read from what was written.
    """
    spark = df.sparkSession
    digest = F.sha2(F.col(content), 256)
    first = df.groupBy(digest.alias("digest")).agg(F.min(F.struct(*df.columns)).alias("_row"))
    hashed = first.select("_row.*", "digest")
    try:
        known = spark.read.parquet(path).select("digest")
        hashed = hashed.join(known, "digest", "left_anti").select(*df.columns, "digest")
    except Exception as error:  # the archive doesn't exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    fresh = written(hashed, "archive")
    fresh.write.mode("append").parquet(path)
    return fresh


def next_batch(universe: DataFrame, state: DataFrame, key: str, done: tuple[str, ...], retry: tuple[str, ...] = (), most_attempts: int = 3) -> DataFrame:
    """The keys still to be worked on: not in a done state, and failed ones only while attempts are left."""
    s = state.select(key, "status", "attempts")
    out = universe.join(s, key, "left")
    again = F.col("status").isin(*retry) & (F.col("attempts") < most_attempts) if retry else F.lit(False)
    return out.where(F.col("status").isNull() | (~F.col("status").isin(*done) & ~F.col("status").isin(*retry or ("",))) | again).drop("status", "attempts")


def release(frames: Mapping[str, DataFrame], folder: str, gate: bool) -> DataFrame:
    """Writes gated tables and the manifest of their files; raises, and writes nothing, if the gate is shut."""
    if not gate:
        raise ValueError("the release gate is shut")
    spark = next(iter(frames.values())).sparkSession
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}")
    sums = manifest(spark, folder)
    sums.write.parquet(f"{folder}-manifest")
    return spark.read.parquet(f"{folder}-manifest")
