import datetime as dt
import random

from pyspark.sql import functions as F

from tidegauge.operators import series as se


def series(spark, data):
    rows = [(k, i, float(v), True, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i)) for k, vs in data.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "key string, i long, value double, observed boolean, bucket_ts timestamp_ntz")


def test_signal_scenarios(spark):
    up = [12, 13, 14, 15, 16, 18, 22, 29, 38, 50, 66, 84]
    down = list(range(88, 26, -6))
    spike = [10] * 24 + [60]
    steady = [50, 51, 49, 50, 52, 50, 49, 51, 50, 50, 51, 49]
    got = {r["key"]: r for r in se.shape_signals(series(spark, {"up": up, "down": down, "spike": spike, "steady": steady}), ["key"]).collect()}
    assert got["up"]["growth_rate"] > 0 and got["up"]["acceleration"] > 0
    assert got["down"]["lifecycle"] == "Declining"
    assert got["spike"]["has_spike"] and got["spike"]["spike_magnitude"] > 20
    assert got["steady"]["persistence"] > 55


def test_trailing_mean_scenario(spark):
    out = se.trailing_mean(series(spark, {"a": [3, 9, 6, 12]}), ["key"], 3).orderBy("i").collect()
    assert [round(r["moving_average"], 6) for r in out] == [3.0, 6.0, 6.0, 9.0]


def test_half_life_envelope_equals_loop(spark):
    rng = random.Random(3)
    values = [0.0 if rng.random() < 0.6 else rng.random() * 100 for _ in range(336)]
    d, want, p = 0.5 ** (1 / 8), [], 0.0
    for v in values:
        p = max(v, p * d)
        want.append(p)
    got = se.half_life_envelope(series(spark, {"a": values}), ["key"], 8, "value").orderBy("i").collect()
    assert max(abs(r["persisted"] - w) for r, w in zip(got, want)) < 1e-9


def test_partial_coverage_is_not_trusted(spark):
    dense = series(spark, {"a": [5] * 40, "b": [5] * 40}).withColumn("observed", (F.col("key") == "a") | (F.col("i") < 10))
    totals = spark.createDataFrame([("a", 200, 50, 20), ("b", 200, 50, 20)], "key string, total_mentions long, unique_posts long, unique_authors long")
    got = {r["key"]: r for r in se.halves_and_trust(dense, totals, "key", 40, 5).collect()}
    assert got["a"]["growth_trusted"] and not got["b"]["growth_trusted"] and got["b"]["growth_rate"] == 0


def test_densify_keeps_the_sum(spark):
    end = 1_704_110_400
    rows = [("k", dt.datetime(2024, 1, 1, 11) + dt.timedelta(seconds=s * 37)) for s in range(90)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz")
    out = se.bucket_ends(df, ["key"], "ts", F.lit(1), end, "1h")
    assert out.count() == 12 and out.agg(F.sum("value")).first()[0] == 90
