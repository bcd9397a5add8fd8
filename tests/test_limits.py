"""Windows, sequential admission, and the same on a stream."""

import datetime

from tessera.streaming import limits


def events(spark, seconds, user=1):
    base = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, base + datetime.timedelta(seconds=s), user) for i, s in enumerate(seconds)], "event_id long, ts timestamp_ntz, user_id long")


def test_only_admitted_attempts_count(spark):
    out = limits.admit_batch(events(spark, [0, 10, 20, 61, 62, 71]), per_minute=2, per_day=100).orderBy("event_id").collect()
    assert [r["admitted"] for r in out] == [True, True, False, True, False, True]
    assert out[2]["retry_after"] == 40_000_000
    daily = limits.admit_batch(events(spark, [0, 100, 200, 86_400]), per_minute=5, per_day=2).orderBy("event_id").collect()
    assert [r["reason"] for r in daily] == [None, None, "day", None]


def test_windows_and_sessions(spark):
    out = limits.attempts_before(events(spark, [0, 30, 60, 61]), 60).orderBy("event_id").collect()
    assert [r["attempts"] for r in out] == [1, 2, 3, 3]
    assert sorted(r["events"] for r in limits.sessions(events(spark, [0, 5, 100, 101]), 60).collect()) == [2, 2]


def test_leases_and_cache(spark):
    day = 86_400_000_000
    leases = spark.createDataFrame([(1, 0, 10), (2, 5, day + 5), (3, day, day + 1), (4, day + 6, day + 7)], "id long, start long, end long")
    assert {r["id"]: r["open"] for r in limits.overlapping_leases(leases).collect()} == {1: 1, 2: 2, 3: 2, 4: 1}
    writes = spark.createDataFrame([(1, 7, 0), (2, 7, 5_000_000)], "id long, key long, at long")
    reads = spark.createDataFrame([(10, 7, 1_000_000), (11, 7, 6_000_000), (12, 7, 60_000_000), (13, 8, 0)], "id long, key long, at long")
    assert {r["read_id"]: r["write_id"] for r in limits.live_cache(writes, reads, 10).collect()} == {10: 1, 11: 2, 12: None, 13: None}


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "events"
    whole = events(spark, [0, 10, 20, 61, 62, 71])
    for part in range(3):
        whole.where(f"event_id >= {part * 2} and event_id < {part * 2 + 2}").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    running = limits.admit_stream(stream, 2, 100).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert running.awaitTermination(45)
    running.stop()
    assert spark.table("admitted").count() == 6
