import datetime as dt

from pyspark.sql import functions as F

from tidegauge.operators import posts as po
from tidegauge.plans import readmodel as rm
from tidegauge.streaming import jobs


def test_refresh_bounds():
    now = dt.datetime(2024, 1, 30, 12, 0, 30)
    assert rm.bounds(now, None) == (rm.FIRST, dt.datetime(2024, 1, 30, 11, 57))
    assert rm.bounds(now, dt.datetime(2024, 1, 30, 11, 0))[0] == dt.datetime(2024, 1, 30, 10, 15)
    start, end = rm.bounds(now, dt.datetime(2024, 1, 30, 13, 0))
    assert start < end


def test_stale_cursor_restarts_near_the_head():
    assert "startingTimestamp" in jobs.broker_options("b", "t", 7200, 600, 1_700_000_000_000)
    assert "startingOffsets" in jobs.broker_options("b", "t", 60, 600, 1_700_000_000_000)


def test_window_prune_scenario(spark):
    as_of = dt.datetime(2024, 1, 30)
    h = lambda n: as_of - dt.timedelta(hours=n)
    posts = spark.createDataFrame([("p1", h(48)), ("p2", h(192))], "id string, ts timestamp_ntz")
    kids = spark.createDataFrame([("c1", "p1", h(5)), ("c2", "p2", h(5)), ("c3", "p1", h(192))], "cid string, pid string, cts timestamp_ntz")
    kept, inside = po.window_prune(posts, kids, "id", "pid", "ts", "cts", F.lit(as_of).cast("timestamp_ntz"))
    assert [r["id"] for r in kept.collect()] == ["p1"] and [r["cid"] for r in inside.collect()] == ["c1"]


def test_future_clock_is_settled(spark):
    t = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(t + dt.timedelta(hours=1), t, t)], "c timestamp_ntz, i timestamp_ntz, g timestamp_ntz")
    assert po.settle_times(df, "c", "i", "g").first()["created_at"] == t


def test_late_and_repeated_events_match_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=20 * i), f"k{i % 3}", 1.0) for i in range(300)]
    schema = "event_id long, ts timestamp, kind string, value double"
    folder = str(tmp_path / "in")
    for n, part in enumerate((rows[:120], rows[100:220], rows[210:])):  # overlapping deliveries
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{folder}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)
    unique = jobs.deduplicated(stream, ["event_id"], "ts", "1 day")
    out = jobs.run_to_end(unique, "late")
    assert out.count() == 300 and out.select("event_id").distinct().count() == 300


def test_a_stopped_stream_resumes(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, kind string, value double"
    folder, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    land = lambda ids: spark.createDataFrame([(i, base + dt.timedelta(minutes=i), f"k{i % 3}", 1.0) for i in ids], schema).coalesce(1).write.mode("append").json(folder)

    def run():
        stream = spark.readStream.schema(schema).json(folder)
        jobs.run_batches(jobs.cumulative_counts(stream, "kind", "kind", ["k0", "k1", "k2"], "ts"), "counts", "update", jobs.write_batch, out, log)

    land(range(100))
    run()
    land(range(100, 150))
    run()
    run()  # nothing new
    got = jobs.totals_of_counts(jobs.latest_state(spark, out, "kind", "span_start"), "kind", ["k0", "k1", "k2"]).orderBy("kind").collect()
    assert [(r["k0"], r["k1"], r["k2"]) for r in got] == [(50, 0, 0), (0, 50, 0), (0, 0, 50)]


def test_replace_days_removes_emptied_days(spark, tmp_path):
    from tidegauge.sources import datasets as ds

    path = str(tmp_path / "t")
    t = lambda d, h=1: dt.datetime(2024, 1, d, h)
    rows = spark.createDataFrame([(1, t(1)), (2, t(2)), (3, t(3, 1)), (4, t(3, 20))], "id long, ts timestamp_ntz")
    ds.replace_days(ds.stored_table(spark, path), rows, path, "ts", F.lit(t(1, 0)).cast("timestamp_ntz"), F.lit(t(4, 0)).cast("timestamp_ntz"))
    ds.replace_days(ds.stored_table(spark, path), rows.limit(0), path, "ts", F.lit(t(2, 0)).cast("timestamp_ntz"), F.lit(t(3, 12)).cast("timestamp_ntz"))
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 4]
