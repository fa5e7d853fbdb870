"""Time-series signals over dense per-key series (key, i, bucket_ts, value).

A series has a bounded number of buckets (a few hundred), whatever the number of events behind it: events are
aggregated to buckets first, so even a key with a third of all events becomes one short series.
Every signal is one shuffle on the key: window columns for index, length and mean, then conditional aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions.basic import clamp, delta_pct, epoch, floor_minutes, pct_change, round1
from tidegauge.operators.windows import top_n

# --- fixed values: buckets per range (points, seconds) --------------------------
RANGES = {"1h": (12, 3600), "6h": (72, 21600), "24h": (288, 86400), "7d": (336, 604800)}
# --- fixed values: momentum trust thresholds --------------------------------------
MIN_MENTIONS, MIN_POSTS, MIN_AUTHORS, MIN_NON_ZERO = 12, 5, 4, 4
MIN_OBSERVED, MIN_WINDOW, MIN_ACCELERATION = 0.50, 0.60, 0.60


def _expand(df: DataFrame, keys: list[str], n: int, label: Column) -> DataFrame:
    """(keys, i, value, observed, bucket_ts) for i = 0..n-1 from per-bucket sums; a map per key, no grid join."""
    packed = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("__m"))
    return packed.select(
        *keys, "__m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i")
    ).select(
        *keys, "i", F.coalesce(F.col("__m")[F.col("i")], F.lit(0.0)).alias("value"),
        F.col("__m")[F.col("i")].isNotNull().alias("observed"), label.alias("bucket_ts"),
    )


def bucket_ends(items: DataFrame, keys: list[str], ts: str, value: Column, as_of: int, range_name: str,
                points: int | None = None) -> DataFrame:
    """Zero-filled series whose labels are bucket ENDS; the last label is ``as_of`` (epoch seconds)."""
    n, seconds = RANGES[range_name]
    n = points or n
    start, step = as_of - seconds, seconds / n
    inside = items.where((F.col(ts) >= F.timestamp_seconds(F.lit(start)).cast("timestamp_ntz"))
                         & (F.col(ts) < F.timestamp_seconds(F.lit(as_of + 1)).cast("timestamp_ntz")))
    slot = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((epoch(ts) - start) / step))).cast("long")
    sums = inside.groupBy(*keys, slot.alias("i")).agg(round1(F.sum(value)).alias("value"))
    end = F.timestamp_seconds(F.least(F.lit(as_of).cast("double"), start + (F.col("i") + 1) * step)).cast("timestamp_ntz")
    return _expand(sums, keys, n, end)


def bucket_starts(items: DataFrame, keys: list[str], ts: str, value: Column, as_of: int, points: int, minutes: int) -> DataFrame:
    """Zero-filled series whose labels are bucket STARTS aligned to the epoch; the last bucket holds ``as_of``."""
    step = minutes * 60
    last = as_of // step * step
    first = last - (points - 1) * step
    inside = items.where((F.col(ts) >= F.timestamp_seconds(F.lit(first)).cast("timestamp_ntz"))
                         & (F.col(ts) < F.timestamp_seconds(F.lit(last + step)).cast("timestamp_ntz")))
    slot = F.floor((epoch(ts) - first) / step).cast("long")
    sums = inside.groupBy(*keys, slot.alias("i")).agg(F.sum(value).cast("double").alias("value"))
    return _expand(sums, keys, points, F.timestamp_seconds(first + F.col("i") * step).cast("timestamp_ntz"))


def inferred_step(points: DataFrame, keys: list[str], ts: str, fallback: int) -> DataFrame:
    """Upper median of the positive gaps between a series' points, in seconds."""
    w = Window.partitionBy(*keys).orderBy(ts)
    gaps = points.select(*keys, (epoch(ts) - F.lag(epoch(ts)).over(w)).alias("gap"))
    # gaps are counted by length, so a long series brings a few rows to its median
    sizes = gaps.groupBy(*keys, F.when(F.col("gap") > 0, F.col("gap")).alias("gap")).agg(F.count("gap").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return sizes.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("gap").isNotNull() & (F.col("upto") >= F.floor(F.col("all") / 2) + 1), F.col("gap"))), F.lit(fallback)).alias("step"))


def rebucket(points: DataFrame, keys: list[str], ts: str, value: str, fallback: int = 300) -> DataFrame:
    """Canonical buckets from first to last point at each series' own inferred step, zero-filled, sums clamped at 0."""
    steps = inferred_step(points, keys, ts, fallback)
    bounds = points.groupBy(*keys).agg(F.min(epoch(ts)).alias("lo"), F.max(epoch(ts)).alias("hi"))
    frame = bounds.join(steps, keys)
    slots = (
        points.join(frame, keys)
        .groupBy(*keys, F.floor((epoch(ts) - F.col("lo")) / F.col("step")).cast("long").alias("i"))
        .agg(F.sum(F.greatest(F.lit(0.0), F.col(value))).alias("value"))
    )
    grid = frame.select(
        *keys, "lo", "step",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / F.col("step")).cast("long"))).alias("i"))
    return grid.join(slots, [*keys, "i"], "left").select(
        *keys, "i", F.coalesce("value", F.lit(0.0)).alias("value"),
        F.timestamp_seconds(F.col("lo") + F.col("i") * F.col("step")).cast("timestamp_ntz").alias("bucket_ts"),
    )


def trailing_mean(df: DataFrame, keys: list[str], n: int, value: str = "value", out: str = "moving_average") -> DataFrame:
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(*keys).orderBy("i").rowsBetween(-(n - 1), 0)))


def time_window_mean(df: DataFrame, keys: list[str], ts: str, seconds: int, value: str = "value", out: str = "window_mean") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(epoch(ts)).rangeBetween(-seconds, 0)
    return df.withColumn(out, round1(F.avg(value).over(w)))


def rolling_sum(df: DataFrame, keys: list[str], n: int, value: str = "value", out: str = "rolling_sum") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.greatest(F.lit(0.0), F.sum(value).over(w)))


def half_life_envelope(df: DataFrame, keys: list[str], half_life: int, value: str, out: str = "persisted") -> DataFrame:
    """p[i] = max(v[i], p[i-1] * d) as a running maximum in log space, d = 2^(-1/half_life)."""
    log_d = math.log(0.5) / max(1, half_life)
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lifted = F.when(F.col(value) > 0, F.ln(F.col(value)) - F.col("i") * log_d)
    top = F.max(lifted).over(w)
    return df.withColumn(out, F.coalesce(F.exp(top + F.col("i") * log_d), F.lit(0.0)))


def signal_curve(df: DataFrame, keys: list[str], rolling: int = 12, average: int = 6, half_life: int = 8) -> DataFrame:
    """raw -> rolling sum -> half-life persistence -> moving average."""
    out = rolling_sum(df, keys, rolling)
    out = half_life_envelope(out, keys, half_life, "rolling_sum")
    return trailing_mean(out, keys, average, "persisted")


def _size(n: Column, fraction: float, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    return F.greatest(low, F.least(F.lit(high), F.floor(n * F.lit(fraction)))).cast("long")


def _mean(cond: Column) -> Column:
    return F.coalesce(F.avg(F.when(cond, F.col("value"))), F.lit(0.0))


def shape_signals(series: DataFrame, keys: list[str]) -> DataFrame:
    """growth, acceleration, spike, persistence and lifecycle stage of every series."""
    per_key = Window.partitionBy(*keys)
    base = series.withColumn("n", F.count(F.lit(1)).over(per_key)).withColumn("mean", F.avg("value").over(per_key))
    n, i = F.col("n"), F.col("i")
    gw = _size(n, 0.14, 4, 18)
    gb = _size(n, 0.28, gw + 2, 32)
    aw = _size(n, 0.12, 3, 14)
    sw = _size(n, 0.08, 3, 8)
    sb = _size(n, 0.2, sw + 3, 24)
    lw = _size(n, 0.1, 3, 10)
    last = lambda size: i >= n - size
    before = lambda skip, size: (i < n - skip) & (i >= n - skip - size)
    agg = base.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.min("value").alias("low"), F.max("value").alias("peak"), F.max_by("value", "i").alias("latest"),
        F.avg((F.col("value") >= F.col("mean") * 0.72).cast("double")).alias("sustained"),
        _mean(last(gw)).alias("g_recent"), _mean(before(gw, gb)).alias("g_base"),
        _mean(last(aw)).alias("a0"), _mean(before(aw, aw)).alias("a1"), _mean(before(aw * 2, aw)).alias("a2"),
        _mean(last(sw)).alias("s_recent"), _mean(before(sw, sb)).alias("s_base"),
        _mean(last(lw)).alias("l_recent"), _mean(before(lw, lw)).alias("l_prev"),
    )
    n = F.col("n")
    floor_one = F.greatest(F.col("mean"), F.lit(1.0))
    stability = 1 - clamp(F.col("sd") / floor_one, 0.0, 1.35) / 1.35
    low_ratio = clamp(F.col("low") / floor_one, 0.0, 1.0)
    out = agg.select(
        *keys, "n", "latest", "peak", "l_recent", "l_prev", "s_recent",
        F.when(n >= 4, round1(pct_change("g_recent", "g_base"))).otherwise(0.0).alias("growth_rate"),
        F.when(n >= 6, round1(pct_change("a0", "a1") - pct_change("a1", "a2"))).otherwise(0.0).alias("acceleration"),
        F.when(n >= 8, round1(pct_change("latest", "s_base"))).otherwise(0.0).alias("spike_magnitude"),
        F.when(n >= 3, round1(clamp((stability * 0.38 + F.col("sustained") * 0.4 + low_ratio * 0.22) * 100, 0.0, 100.0)))
        .otherwise(0.0).alias("persistence"),
    )
    out = out.withColumn(
        "has_spike", (n >= 8) & (F.col("spike_magnitude") >= 22) & (F.col("latest") > F.col("s_recent") * 1.06)
    )
    return out.withColumn("lifecycle", lifecycle_stage()).drop("l_recent", "l_prev", "s_recent")


def lifecycle_stage() -> Column:
    g, a = F.col("growth_rate"), F.col("acceleration")
    latest, peak, recent, prev = F.col("latest"), F.col("peak"), F.col("l_recent"), F.col("l_prev")
    near_peak = latest >= peak * 0.94
    down = recent < prev * 0.985
    breakout = latest / F.greatest(prev, F.lit(1.0))
    return (
        F.when(F.col("n") < 4, "Emerging")
        .when((g <= -5) | ((a <= -2.2) & down & (latest < peak * 0.88)), "Declining")
        .when(((g >= 8) & (a >= 0.9) & (latest < peak * 0.985)) | ((g >= 5) & (breakout >= 1.35) & (recent > prev * 1.2)), "Expanding")
        .when(near_peak & (g >= -1.5) & (g <= 5.5) & (F.abs(a) <= 2.2), "Established")
        .when((near_peak & (a < -0.7)) | ((g >= 0) & (a < -1.6)), "Fading")
        .when((g > 1.5) | (a > 0.5), "Emerging")
        .otherwise(F.when(down, "Declining").otherwise("Established"))
    )


def platform_signals(series: DataFrame, topic: list[str], platform: str) -> DataFrame:
    """Per topic and platform: early score, first strong index, recent delta and change."""
    keys = [*topic, platform]
    per_key = Window.partitionBy(*keys)
    base = series.withColumn("n", F.count(F.lit(1)).over(per_key)).withColumn("peak", F.max("value").over(per_key))
    n, i, v = F.col("n"), F.col("i"), F.col("value")
    ew, rw = _size(n, 0.2, 4, 20), _size(n, 0.12, 3, 14)
    out = base.groupBy(*keys).agg(
        _mean(i < ew).alias("early_mean"), F.max(F.when(i < ew, v)).alias("early_peak"), F.max("peak").alias("peak"),
        F.coalesce(F.min(F.when(v >= F.col("peak") * 0.62, i)), F.max("n")).alias("first_strong"),
        _mean(i >= n - rw).alias("recent"), _mean((i < n - rw) & (i >= n - rw * 2)).alias("previous"),
    )
    return (
        out.withColumn("early_score", F.col("early_mean") * 0.72 + F.col("early_peak") * 0.28)
        .withColumn("delta", F.col("recent") - F.col("previous"))
        .withColumn("delta_pct", round1(pct_change("recent", "previous")))
    )


def origin_platform(signals: DataFrame, topic: list[str], platform: str) -> DataFrame:
    return top_n(signals, topic, [F.col("early_score").desc(), F.col(platform).asc()], 1).select(
        *topic, F.col(platform).alias("origin_platform"), "early_score"
    )


def migration_path(signals: DataFrame, topic: list[str], platform: str) -> DataFrame:
    """Platforms ordered by when they first reached 62 % of their own peak."""
    return signals.groupBy(*topic).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("first_strong", (-F.col("peak")).alias("p"), F.col(platform).alias("id")))),
            lambda x: x["id"],
        ).alias("path")
    )


def attention_drivers(signals: DataFrame, topic: list[str], platform: str) -> DataFrame:
    """Three largest drivers: platforms that grew, or all platforms when none did; share of the total gain."""
    per_topic = Window.partitionBy(*topic)
    grew = signals.withColumn("any_up", F.max((F.col("delta") > 0).cast("int")).over(per_topic))
    source = grew.where((F.col("any_up") == 0) | (F.col("delta") > 0))
    gain = F.greatest(F.col("delta"), F.lit(0.01))
    source = source.withColumn("total", F.sum(gain).over(per_topic))
    ranked = top_n(source, topic, [F.col("delta").desc(), F.col(platform).asc()], 3, "driver_rank")
    return ranked.select(*topic, platform, "driver_rank", round1(gain / F.col("total") * 100).alias("contribution_pct"), "delta_pct")


def window_totals(series: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the last window and of the one before it, window = 8 % of the series, 1..12 buckets."""
    base = series.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    n, i = F.col("n"), F.col("i")
    w = F.greatest(F.lit(1), F.least(F.lit(12), F.floor(n * F.lit(0.08))))
    return base.groupBy(*keys).agg(
        F.sum(F.when(i >= n - w, F.col("value")).otherwise(0.0)).alias("current_total"),
        F.sum(F.when((i < n - w) & (i >= n - w * 2), F.col("value")).otherwise(0.0)).alias("previous_total"),
    )


def previous_day_total(items: DataFrame, keys: list[str], ts: str, value: Column, as_of: Column) -> DataFrame:
    end = as_of - F.expr("INTERVAL 24 HOURS")
    start = as_of - F.expr("INTERVAL 48 HOURS")
    return items.where((F.col(ts) >= start) & (F.col(ts) < end)).groupBy(*keys).agg(F.sum(value).alias("previous_day"))


def halves_and_trust(series: DataFrame, totals: DataFrame, key: str, points: int, bucket_minutes: int) -> DataFrame:
    """Half-over-half growth, quarter acceleration and velocity, with coverage-based trust.

    ``series`` carries the observed flag of every bucket: a zero that was written counts as observed, a filled one
    does not.  ``totals`` has total_mentions, unique_posts and unique_authors per key."""
    n = points
    mid, q = max(1, n // 2), max(1, n // 4)
    i, v = F.col("i"), F.col("value")
    obs = lambda cond: F.count_if(cond & F.col("observed"))
    total = lambda cond: F.sum(F.when(cond, v).otherwise(0.0))
    parts = series.groupBy(key).agg(
        total(i < mid).alias("prev_half"), total(i >= mid).alias("recent_half"),
        total((i >= n - 2 * q) & (i < n - q)).alias("prev_quarter"), total(i >= n - q).alias("recent_quarter"),
        obs(F.lit(True)).alias("observed_buckets"), F.count_if(v > 0).alias("non_zero_buckets"),
        obs(i < mid).alias("o_prev"), obs(i >= mid).alias("o_recent"),
        obs((i >= n - 2 * q) & (i < n - q)).alias("o_aprev"), obs(i >= n - q).alias("o_arecent"),
        F.max(F.when(v > 0, F.col("bucket_ts"))).alias("latest_data"),
    )
    df = totals.join(parts, key, "left").fillna(
        0, ["prev_half", "recent_half", "prev_quarter", "recent_quarter", "observed_buckets", "non_zero_buckets",
            "o_prev", "o_recent", "o_aprev", "o_arecent"]
    )
    m = F.col("total_mentions")
    posts = F.greatest(F.col("unique_posts"), F.when(m > 0, 1).otherwise(0))
    authors = F.col("unique_authors")
    df = df.withColumn("posts", posts)
    support = (m >= MIN_MENTIONS).cast("int") + (posts >= MIN_POSTS).cast("int") + (authors >= MIN_AUTHORS).cast("int")
    df = df.withColumn("supported", (support >= 2) & (m >= max(4, MIN_MENTIONS // 2)))
    cap = lambda x, top: F.least(F.lit(1.0), x / F.lit(float(top)))
    df = df.withColumn("support_ratio", (cap(m, MIN_MENTIONS) + cap(posts, MIN_POSTS) + cap(authors, MIN_AUTHORS)) / 3)
    df = (
        df.withColumn("cov_all", F.col("observed_buckets") / n).withColumn("cov_prev", F.col("o_prev") / mid)
        .withColumn("cov_recent", F.col("o_recent") / (n - mid)).withColumn("cov_aprev", F.col("o_aprev") / q)
        .withColumn("cov_arecent", F.col("o_arecent") / q)
    )
    seen = F.col("supported") & (F.col("cov_all") >= MIN_OBSERVED) & (F.col("non_zero_buckets") >= MIN_NON_ZERO)
    df = (
        df.withColumn("growth_trusted", seen & (F.col("cov_prev") >= MIN_WINDOW) & (F.col("cov_recent") >= MIN_WINDOW))
        .withColumn("acceleration_trusted", seen & (F.col("cov_aprev") >= MIN_ACCELERATION) & (F.col("cov_arecent") >= MIN_ACCELERATION))
        .withColumn("velocity_trusted", seen & (F.col("cov_arecent") >= MIN_ACCELERATION))
    )
    trust = lambda flag, *xs: F.when(F.col(flag), F.least("support_ratio", "cov_all", *xs)).otherwise(0.0)
    df = (
        df.withColumn("growth_trust", trust("growth_trusted", "cov_prev", "cov_recent"))
        .withColumn("acceleration_trust", trust("acceleration_trusted", "cov_aprev", "cov_arecent"))
        .withColumn("velocity_trust", trust("velocity_trusted", "cov_arecent"))
    )
    df = df.withColumn("momentum_trust", F.greatest("growth_trust", "acceleration_trust", "velocity_trust"))
    quarter_hours = max(q * bucket_minutes / 60, bucket_minutes / 60, 1 / 60)
    full_hours = max(n * bucket_minutes / 60, bucket_minutes / 60, 1 / 60)
    fallback = clamp(m / F.lit(full_hours), 0.0, 1000.0)
    raw_velocity = F.when(F.col("observed_buckets") > 0, clamp(F.col("recent_quarter") / F.lit(quarter_hours), 0.0, 1000.0)).otherwise(fallback)
    raw_growth = clamp(delta_pct("recent_half", "prev_half"), -100.0, 400.0)
    raw_accel = clamp(delta_pct("recent_quarter", "prev_quarter"), -100.0, 400.0)
    return (
        df.withColumn("growth_rate", F.when(F.col("growth_trusted"), clamp(raw_growth * F.col("growth_trust"), -100.0, 400.0)).otherwise(0.0))
        .withColumn("acceleration", F.when(F.col("acceleration_trusted"), clamp(raw_accel * F.col("acceleration_trust"), -100.0, 400.0)).otherwise(0.0))
        .withColumn("velocity", F.when(F.col("velocity_trusted"), clamp(raw_velocity * F.greatest(F.lit(0.45), F.col("velocity_trust")), 0.0, 1000.0)).otherwise(fallback))
    )


def clip_to_window(points: DataFrame, keys: list[str], ts: str, value: str, as_of: int, range_name: str) -> DataFrame:
    """Points of the live window plus gap metadata and the coverage test of every series."""
    _, seconds = RANGES[range_name]
    steps = inferred_step(points, keys, ts, 1800 if range_name == "7d" else 300)
    meta = points.groupBy(*keys).agg(
        F.min(epoch(ts)).alias("first_s"), F.max(epoch(ts)).alias("last_s"),
        F.max(F.when(F.col(value) > 0, epoch(ts))).alias("data_s"),
        F.count_if((epoch(ts) >= as_of - seconds) & (epoch(ts) <= as_of)).alias("points_inside"),
    ).join(steps, keys)
    span = F.greatest(F.col("step"), F.col("last_s") - F.col("first_s") + F.col("step"))
    return meta.select(
        *keys, "points_inside", F.timestamp_seconds("last_s").cast("timestamp_ntz").alias("latest_point_at"),
        F.timestamp_seconds("data_s").cast("timestamp_ntz").alias("latest_data_at"),
        F.greatest(F.lit(0), F.floor((as_of - F.col("last_s")) / 60 + 0.5)).cast("long").alias("stale_gap_minutes"),
        F.greatest(F.lit(0), F.ceil((as_of - F.col("last_s")) / F.col("step"))).cast("long").alias("trailing_gap_buckets"),
        F.greatest(F.lit(1), F.floor(F.col("step") / 60 + 0.5)).cast("long").alias("bucket_minutes"),
        (span >= seconds * 0.9).alias("covers_window"),
    )


def add_series(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, "i", "value").unionByName(b.select(*keys, "i", "value")).groupBy(*keys, "i").agg(
        round1(F.sum("value")).alias("value")
    )


def prefer_non_empty(main: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """The main series of a key when it has any positive value, else its fallback series."""
    both = main.select(*keys, "i", F.col("value").alias("a"), F.lit(None).cast("double").alias("b")).unionByName(
        fallback.select(*keys, "i", F.lit(None).cast("double").alias("a"), F.col("value").alias("b"))
    ).groupBy(*keys, "i").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    total = F.sum(F.coalesce("a", F.lit(0.0))).over(Window.partitionBy(*keys))
    return both.withColumn("value", F.when(total > 0, F.coalesce("a", F.lit(0.0))).otherwise(F.coalesce("b", F.lit(0.0)))).drop("a", "b")


def leadership(series: DataFrame, key: str, per_bucket: int = 5) -> DataFrame:
    """Score of holding one of the top places bucket by bucket (value times rank weight)."""
    ranked = top_n(series.where("value > 0"), ["i"], [F.col("value").desc(), F.col(key).asc()], per_bucket, "place")
    return ranked.groupBy(key).agg(
        F.sum(F.col("value") * (F.lit(per_bucket + 1) - F.col("place"))).alias("score"),
        F.count(F.lit(1)).alias("buckets_led"), F.max("value").alias("peak"),
    )
