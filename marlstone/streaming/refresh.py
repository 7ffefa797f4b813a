"""The trailing metrics and the guarded refresh over a stream. An extension: the batch operators are the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sets import last_good


def live_metrics(facts: DataFrame, entity: str, when: str, value: str, window: str = "30 days", slide: str = "1 day", late: str = "7 days") -> DataFrame:
    """(entity, from, until, n, mean, low, high) of sliding windows; facts later than `late` are dropped with their windows."""
    w = F.window(when, window, slide)
    out = facts.withWatermark(when, late).groupBy(entity, w.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(entity, F.col("w.start").alias("from"), F.col("w.end").alias("until"), "n", "mean", "low", "high")


def guarded_refresh(updates: DataFrame, state_dir: str, checkpoint: str, key: str, value: str, good: str, reviewed: str, when: str | None = None) -> StreamingQuery:
    """Merges each batch of updates into a table of last good values; each batch is a new version, named by its number.

    A batch that runs again after a failure writes the same version, so it counts once. Of several updates of a key in a
    batch a good one counts, the latest by `when` if that is given, then the reviewed one, then the largest value.
    """
    spark = updates.sparkSession
    order = F.struct(F.coalesce(F.col(good), F.lit(False)), *([F.col(when)] if when else []), F.coalesce(F.col(reviewed), F.lit(False)), F.col(value))

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(key).agg(F.max_by(F.struct(value, good, reviewed), order).alias("s")).select(key, f"s.{value}", f"s.{good}", f"s.{reviewed}")
        if number:
            old = spark.read.parquet(f"{state_dir}/version={number - 1}")
            kept = last_good(old, new, key, value, good, reviewed)
            flags = old.select(key, F.col(good).alias("_g"), F.col(reviewed).alias("_r")).join(new.select(key, F.col(good).alias("_ng"), F.col(reviewed).alias("_nr")), key, "full")
            new = kept.join(flags, key).select(key, value, F.when(F.col("source") == "old", F.col("_g")).otherwise(F.col("_ng")).alias(good), F.when(F.col("source") == "old", F.col("_r")).otherwise(F.col("_nr")).alias(reviewed))
        new.write.mode("overwrite").parquet(f"{state_dir}/version={number}")

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
