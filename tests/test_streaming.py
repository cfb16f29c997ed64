from pyspark.sql import functions as F

from tessera.operators import runs
from tessera.streaming import events


def stage(spark, small, tmp_path):
    path = str(tmp_path / "in")
    spark.read.parquet(f"{small}/events.parquet").repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def test_streamed_windows_equal_the_batch(spark, small, tmp_path):
    path = stage(spark, small, tmp_path)
    stream = events.tumbling(events.read_events(spark, path), "1 day", late="40 days")
    out = str(tmp_path / "out")
    query = stream.writeStream.format("memory").queryName("tumbling").outputMode("complete").option("checkpointLocation", out).trigger(availableNow=True).start()
    query.awaitTermination(120)
    wanted = events.tumbling(spark.read.parquet(path), "1 day").collect()
    assert sorted(map(repr, spark.table("tumbling").collect())) == sorted(map(repr, wanted)) and wanted


def test_appended_windows_and_restart(spark, small, tmp_path):
    path, out, at = stage(spark, small, tmp_path), str(tmp_path / "out"), str(tmp_path / "at")
    for _ in range(2):
        stream = events.tumbling(events.read_events(spark, path), "1 day")
        events.write_available(stream, out, at).awaitTermination(120)
    found = spark.read.parquet(out)
    assert found.count() == found.select("event_type", "start").distinct().count() > 0


def test_run_states(spark, small, tmp_path):
    path = stage(spark, small, tmp_path)
    stream = events.run_states(events.read_events(spark, path), idle="400 days", late="40 days")
    query = stream.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = spark.table("states").groupBy("user_id").agg(F.max("n_events").alias("n"))
    wanted = spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, wanted.collect()))


def test_rate_limits_equal_the_batch(spark, small, tmp_path):
    path = str(tmp_path / "in")
    spark.read.parquet(f"{small}/events.parquet").coalesce(1).sortWithinPartitions("ts").write.parquet(path)
    stream = events.rate_limited(events.read_events(spark, path), "user_id", 86400, 2, late="40 days")
    out = str(tmp_path / "out")
    events.write_available(stream, out, str(tmp_path / "c")).awaitTermination(120)
    wanted = runs.sliding_count(spark.read.parquet(path), "user_id", "ts", 86400).selectExpr("event_id", "user_id", "in_window > 2 as limited")
    found = sorted(map(tuple, spark.read.parquet(out).select("event_id", "user_id", "limited").collect()))
    assert found == sorted(map(tuple, wanted.collect())) and any(r[2] for r in found)


def test_an_event_one_window_old_has_left_it(spark):
    rows = spark.createDataFrame([(1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:01:00"), (3, 7, "2024-01-01 00:01:59.999999")], "event_id long, user_id long, t string").selectExpr("event_id", "user_id", "cast(t as timestamp_ntz) as ts")
    assert [r["in_window"] for r in runs.sliding_count(rows, "user_id", "ts", 60).orderBy("event_id").collect()] == [1, 1, 2]


def test_messages(spark):
    rows = [('{"type": "step", "tenantId": "t", "docVersionId": "v", "timestamp": "2024-01-01T00:00:00Z", "data": {"status": "ok"}}',), ("{broken",), ('{"type": "step"}',)]
    parsed = events.parse_messages(spark.createDataFrame(rows, "value string"))
    assert parsed.count() == 1 and events.subscribe(parsed, "t", "v").count() == 1 and events.subscribe(parsed, "x").count() == 0
    doubled = spark.createDataFrame([(1, "k"), (2, "k"), (3, "l")], "i int, key string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert events.once(doubled, "key").count() == 2
