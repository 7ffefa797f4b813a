"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in estimated bytes, that is handed to every executor. Beyond it joins shuffle.
BROADCAST_BYTES = 32 << 20

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where that is unset in local mode."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return _own[app]


def written(df: DataFrame, what: str) -> DataFrame:
    """`df`, written once and read again: what it is made of isn't computed twice, and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table marked for broadcast if its rows, of `row_bytes` bytes, stay under `limit`; else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
