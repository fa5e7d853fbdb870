"""Snapshots with timers, and keyed merges, over several batches, restarts, replays and out-of-order rows."""

import datetime as dt
import itertools
import os

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import datasets as ds, merging as mg
from tidegauge.streaming import jobs, snapshots as sn

BASE = dt.datetime(2024, 1, 1)
KINDS = {"likes": "like", "replies": "reply"}
SCHEMA = "id long, ts timestamp, k string, kind string"


def minutes(n, s=0):
    return BASE + dt.timedelta(minutes=n, seconds=s)


def land(spark, folder, rows):
    spark.createDataFrame([(i, t, k, kind) for i, (t, k, kind) in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").json(folder)


def run(spark, where):
    events = spark.readStream.schema(SCHEMA).json(f"{where}/in")
    steps = sn.activity(events, "k", "kind", KINDS, "ts")
    with sn.timer_state(spark):
        return jobs.run_to_end(sn.snapshots(steps, "k", list(KINDS), 60), "s", out=f"{where}/out", log=f"{where}/log")


def expected(rows, until, retention=60):
    """Plain walk over the closed steps."""
    found = {}
    for t, k, kind in rows:
        if k is not None and kind in KINDS.values():
            end = t.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
            if end <= until:
                found.setdefault(k, {}).setdefault(end, []).append(kind)
    out = []
    for k, steps in found.items():
        likes = replies = 0
        last = None
        for end in sorted(steps):
            if last and end - last > dt.timedelta(minutes=retention):
                likes = replies = 0
                last = None
            a, b = steps[end].count("like"), steps[end].count("reply")
            likes, replies = likes + a, replies + b
            out.append((k, end, last, likes, replies, a, b, (end - last).total_seconds() / 60 if last else 0.0))
            last = end
    return sorted(out, key=lambda r: (r[0], r[1]))


def got(df):
    rows = df.select("k", "snapshot_at", "previous_at", "likes", "replies", "delta_likes", "delta_replies", "delta_minutes").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1]))


def test_snapshots_resume_expire_and_drop_late_rows(spark, tmp_path):
    where = str(tmp_path)
    first = [(minutes(m, s), f"k{m % 3}", "like" if m % 2 else "reply") for m in range(0, 40) for s in (0, 20)] + [
        (minutes(5), None, "like"), (minutes(6), "k0", "other"), (minutes(2), "gone", "like"), (minutes(3), "gone", "reply")]
    second = [(minutes(m), "k1", "like") for m in range(40, 300, 7)]  # moves the watermark beyond the life of the others
    third = [(minutes(301), "gone", "like"), (minutes(302), "k0", "reply"), (minutes(400), "end", "like")]
    land(spark, f"{where}/in", first)
    run(spark, where)
    land(spark, f"{where}/in", second)
    run(spark, where)  # a new query on the old checkpoint
    late = [(minutes(10), "k0", "like"), (minutes(50), "k2", "like")]  # far behind the watermark: dropped
    land(spark, f"{where}/in", third + late)
    out = run(spark, where)
    assert got(out) == expected(first + second + third, minutes(397))
    assert got(run(spark, where)) == got(out)  # nothing new
    again = [r for r in got(out) if r[0] == "gone"]
    assert [r[3:5] for r in again] == [(1, 0), (1, 1), (1, 0)] and again[-1][2] is None
    assert out.select("snapshot_id").distinct().count() == out.count()


def test_batches_do_not_matter_to_snapshots(spark, tmp_path):
    rows = [(minutes((i * 37) % 600, i % 60), f"k{i % 5}", "like" if i % 3 else "reply") for i in range(400)]
    rows.sort()
    for name, cuts in (("one", [0, 400]), ("many", [0, 90, 91, 250, 400])):
        for a, b in itertools.pairwise(cuts):
            land(spark, f"{tmp_path}/{name}/in", rows[a:b])
            if name == "many":
                run(spark, f"{tmp_path}/{name}")
    many, one = got(run(spark, f"{tmp_path}/many")), got(run(spark, f"{tmp_path}/one"))
    assert one == many == expected(rows, max(r[0] for r in rows) - dt.timedelta(minutes=3))


RULES = mg.MergeRules(key=("id", "part"), version="seen", greatest=("at", "score"), latest=("mood", "flag"), known=("author",))
ROWS = "id long, part string, seen timestamp_ntz, at timestamp_ntz, score double, mood string, flag boolean, author string, extra int"


def rows_of():
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    return [
        (1, "a", t(5), t(1), 0.4, "pos", True, "x", 1), (1, "a", t(6), t(1), 0.3, "neg", None, None, 2), (1, "a", t(4), t(2), 0.9, None, False, "y", 3),
        (2, "a", t(5), t(1), 0.1, "pos", True, None, 4), (2, "b", t(5), t(1), 0.1, "pos", True, None, 5),
        (3, None, t(5), t(3), None, None, None, "z", 6), (3, None, t(5), t(3), 0.2, "neg", True, "w", 7),  # same version: by value
        (None, "a", None, None, 0.5, "pos", True, "n", 8), (None, "a", t(1), None, 0.1, "neg", True, None, 9),
        (4, "a", t(5), t(7), 0.1, "pos", True, "q", 10), (4, "a", t(6), t(8), 0.1, "pos", True, None, 11),  # leaves the seventh
    ]


def content(spark, path):
    return sorted(map(tuple, mg.read_merged(spark, path, RULES).collect()), key=str)


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 1, 0], [1, 0, 1, 2, 2, 0]])
def test_replayed_and_out_of_order_batches_merge_to_the_same_rows(spark, tmp_path, order):
    rows = rows_of()
    path, whole = f"{tmp_path}/t", f"{tmp_path}/whole"
    mg.merge_days(spark.createDataFrame(rows, ROWS), whole, RULES, "at")
    for n in order:
        mg.merge_days(spark.createDataFrame(rows[n::3], ROWS), path, RULES, "at")
    assert content(spark, path) == content(spark, whole)
    one = {r[0:2]: r for r in content(spark, path)}
    assert one[(1, "a")][2:] == (dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 2), 0.9, "neg", None, "x")
    assert not os.path.exists(f"{path}/day=2024-01-07")  # its only row moved on


def test_only_touched_days_are_rewritten_and_a_torn_merge_heals(spark, tmp_path):
    path = f"{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, ROWS)
    t = lambda d: dt.datetime(2024, 1, d)
    row = lambda i, d, seen=1: (i, "a", t(seen), t(d), 0.1, "pos", True, None, 0)
    assert mg.merge_days(make([]), path, RULES, "at") == [] and ds.stored_table(spark, path) is None
    mg.merge_days(make([row(i, i) for i in range(1, 6)]), path, RULES, "at")
    before = {d: os.listdir(f"{path}/day=2024-01-0{d}") for d in range(1, 6)}
    days = mg.merge_days(make([row(2, 3, 2)]), path, RULES, "at", horizon_days=1)
    assert [d.day for d in days] == [2, 3] and not os.path.exists(f"{path}/day=2024-01-02")
    assert all(os.listdir(f"{path}/day=2024-01-0{d}") == before[d] for d in (1, 4, 5))
    # a copy of a moved row that a broken run left behind goes with the repetition
    stale = mg.with_versions(make([row(2, 2)]), RULES).withColumn("day", F.lit(t(2).date()))
    stale.write.mode("append").partitionBy("day").parquet(path)
    mg.merge_days(make([row(2, 3, 2)]), path, RULES, "at")
    assert [(r[0], r[3].day) for r in content(spark, path)] == [(1, 1), (2, 3), (3, 3), (4, 4), (5, 5)]
