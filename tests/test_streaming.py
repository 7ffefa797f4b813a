"""Streams over files: sliding windows, and values that bad refreshes don't replace."""

from datetime import datetime

from marlstone.streaming.refresh import guarded_refresh, live_metrics


def test_live_metrics(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1), 2.0), ("a", datetime(2024, 1, 2), 4.0), ("b", datetime(2024, 1, 1), 1.0)]
    spark.createDataFrame(rows, "k string, ts timestamp, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(f"{tmp_path}/in")
    query = live_metrics(stream, "k", "ts", "v", "2 days", "2 days").writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(60)
    got = [(r.k, r.n) for r in spark.table("live").collect()]
    assert sum(n for _, n in got) == 3 and ("b", 1) in got


def test_guarded_refresh(spark, tmp_path):
    schema = "k int, v double, good boolean, reviewed boolean"
    for number, batch in enumerate([[(1, 1.0, True, False), (2, 2.0, True, True), (3, 3.0, False, False)], [(1, 9.0, False, False), (2, 8.0, True, False), (3, 7.0, True, False), (4, 4.0, True, False)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        guarded_refresh(stream, f"file://{tmp_path}/state", f"{tmp_path}/c", "k", "v", "good", "reviewed").awaitTermination(60)
        assert number == 0 or {r.k: r.v for r in spark.read.parquet(f"{tmp_path}/state/version=1").collect()} == {1: 1.0, 2: 2.0, 3: 7.0, 4: 4.0}


def test_of_several_good_updates_the_latest_counts(spark, tmp_path):
    rows = [(1, 5.0, True, False, 1), (1, 4.0, True, False, 3), (1, 9.0, True, False, 2), (1, 8.0, False, False, 9), (2, 1.0, True, False, 1), (2, 2.0, True, True, 1)]
    spark.createDataFrame(rows, "k int, v double, good boolean, reviewed boolean, at int").repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, v double, good boolean, reviewed boolean, at int").parquet(f"{tmp_path}/in")
    guarded_refresh(stream, f"file://{tmp_path}/state", f"{tmp_path}/c", "k", "v", "good", "reviewed", when="at").awaitTermination(60)
    assert {r.k: r.v for r in spark.read.parquet(f"{tmp_path}/state/version=0").collect()} == {1: 4.0, 2: 2.0}
