"""Time-series signals on event series (subject = JSON number mod 10, platform = event type)."""

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import big, r6, ts
from tidegauge.operators import series as se, windows as wi
from tidegauge.plans import standins as st

AS_OF = 1706616000  # 2024-01-30 12:00:00 UTC


def items(spark, sf):
    return st.actions(spark, sf).withColumn("subject", F.col("k") % 10)


def week(spark, sf, keys=("subject",)):
    return se.bucket_ends(items(spark, sf), list(keys), "ts", F.lit(1), AS_OF, "7d")


def week_sql(keys="subject", points=336, step=1800, value="1"):
    return f"""{st.ACTIONS_SQL}, items AS (SELECT *, k % 10 AS subject, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM actions),
inside AS (SELECT * FROM items WHERE s >= {AS_OF - points * step} AND s <= {AS_OF}),
sums AS (SELECT {keys}, least({points - 1}, greatest(0, CAST(floor((s - {AS_OF - points * step}) / {step}) AS BIGINT))) AS i,
  sum({value})::DOUBLE AS v FROM inside GROUP BY ALL),
series AS (SELECT t.*, g.i, coalesce(v, 0.0::DOUBLE) AS value, v IS NOT NULL AS observed,
  to_timestamp({AS_OF - points * step} + (g.i + 1) * {step})::TIMESTAMP AS bucket_ts
  FROM (SELECT DISTINCT {keys} FROM inside) t CROSS JOIN range({points}) g(i) LEFT JOIN sums USING ({keys}, i))"""


_ROW = f"subject, CAST(i AS BIGINT) AS i, {r6('value')} AS value, observed, {ts('bucket_ts')} AS bucket_ts"


@query("series_end_labels", f"WITH {week_sql()} SELECT {_ROW} FROM series")
def _(spark, sf):
    return week(spark, sf)


_FIRST = AS_OF // 300 * 300 - 287 * 300


@query(
    "series_start_labels",
    f"""WITH {st.ACTIONS_SQL}, items AS (SELECT *, k % 10 AS subject, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM actions),
    inside AS (SELECT * FROM items WHERE s >= {_FIRST} AND s < {AS_OF // 300 * 300 + 300}),
    sums AS (SELECT subject, CAST(floor((s - {_FIRST}) / 300) AS BIGINT) AS i, sum(value) AS v FROM inside GROUP BY ALL)
    SELECT t.subject, CAST(g.i AS BIGINT) AS i, {r6('coalesce(v, 0)')} AS value, v IS NOT NULL AS observed,
      {ts(f'to_timestamp({_FIRST} + g.i * 300)::TIMESTAMP')} AS bucket_ts
    FROM (SELECT DISTINCT subject FROM inside) t CROSS JOIN range(288) g(i) LEFT JOIN sums USING (subject, i)""",
)
def _(spark, sf):
    return se.bucket_starts(items(spark, sf), ["subject"], "ts", F.col("value"), AS_OF, 288, 5)


# series of days: one point per user and active day, an irregular input for the inferred step
_DAILY = f"""{st.ACTIONS_SQL}, daily AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value) AS value FROM actions GROUP BY 1, 2)"""
_STEPS = """steps AS (SELECT user_id, CASE WHEN count(*) FILTER (WHERE gap > 0) > 0 THEN
  list_sort(list(gap) FILTER (WHERE gap > 0))[len(list(gap) FILTER (WHERE gap > 0)) // 2 + 1] ELSE 300 END AS step
  FROM (SELECT user_id, CAST(epoch(day) - lag(epoch(day)) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS gap FROM daily) GROUP BY 1)"""


def daily(spark, sf):
    return st.actions(spark, sf).groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.sum("value").alias("value")
    )


@query("series_inferred_step", f"WITH {_DAILY}, {_STEPS} SELECT user_id, step FROM steps")
def _(spark, sf):
    return se.inferred_step(daily(spark, sf), ["user_id"], "day", 300)


@query(
    "series_rebucket",
    f"""WITH {_DAILY}, {_STEPS}, b AS (SELECT user_id, CAST(min(epoch(day)) AS BIGINT) AS lo, CAST(max(epoch(day)) AS BIGINT) AS hi FROM daily GROUP BY 1),
    f AS (SELECT * FROM b JOIN steps USING (user_id)),
    sums AS (SELECT user_id, CAST(floor((epoch(day) - lo) / step) AS BIGINT) AS i, sum(greatest(0, value)) AS v FROM daily JOIN f USING (user_id) GROUP BY 1, 2),
    grid AS (SELECT user_id, lo, step, unnest(generate_series(0, CAST(floor((hi - lo) / step) AS BIGINT))) AS i FROM f)
    SELECT user_id, CAST(i AS BIGINT) AS i, {r6('coalesce(v, 0)')} AS value, {ts('to_timestamp(lo + i * step)::TIMESTAMP')} AS bucket_ts
    FROM grid LEFT JOIN sums USING (user_id, i)""",
)
def _(spark, sf):
    return se.rebucket(daily(spark, sf), ["user_id"], "day", "value")


_CURVE = """rolled AS (SELECT *, greatest(0, sum(value) OVER (PARTITION BY subject ORDER BY i ROWS 11 PRECEDING)) AS rolling_sum FROM series),
persisted AS (SELECT a.subject, a.i, any_value(a.value) AS value, any_value(a.rolling_sum) AS rolling_sum,
  max(b.rolling_sum * pow(0.5, (a.i - b.i) / 8.0)) AS persisted
  FROM rolled a JOIN rolled b ON a.subject = b.subject AND b.i <= a.i GROUP BY a.subject, a.i)"""


@query(
    "series_signal_curve",
    f"""WITH {week_sql()}, {_CURVE} SELECT subject, CAST(i AS BIGINT) AS i, {r6('value')} AS value, {r6('rolling_sum')} AS rolling_sum,
    {r6('persisted')} AS persisted, {r6('avg(persisted) OVER (PARTITION BY subject ORDER BY i ROWS 5 PRECEDING)')} AS moving_average FROM persisted""",
)
def _(spark, sf):
    return se.signal_curve(week(spark, sf), ["subject"]).drop("observed", "bucket_ts")


@query(
    "series_moving_averages",
    f"""WITH {week_sql()} SELECT subject, CAST(i AS BIGINT) AS i, {r6('avg(value) OVER (PARTITION BY subject ORDER BY i ROWS 2 PRECEDING)')} AS moving_average,
    {r6('floor(avg(value) OVER (PARTITION BY subject ORDER BY bucket_ts RANGE INTERVAL 2 HOUR PRECEDING) * 10 + 0.5) / 10')} AS window_mean FROM series""",
)
def _(spark, sf):
    df = se.trailing_mean(week(spark, sf), ["subject"], 3)
    return se.time_window_mean(df, ["subject"], "bucket_ts", 7200).select("subject", "i", "moving_average", "window_mean")


from tidegauge.catalog.sqlkit import r1 as _r1  # noqa: E402


def _pc(a, b):
    return f"((({a}) - ({b})) / greatest({b}, 1.0) * 100)"


_SHAPE = f"""packed AS (SELECT subject, list(value ORDER BY i) AS v FROM series GROUP BY 1),
w AS (SELECT *, len(v) AS n, list_avg(v) AS mean, greatest(4, least(18, floor(len(v) * 0.14)))::INT AS gw,
  greatest(3, least(14, floor(len(v) * 0.12)))::INT AS aw, greatest(3, least(8, floor(len(v) * 0.08)))::INT AS sw,
  greatest(3, least(10, floor(len(v) * 0.1)))::INT AS lw FROM packed),
w2 AS (SELECT *, greatest(gw + 2, least(32, floor(n * 0.28)))::INT AS gb, greatest(sw + 3, least(24, floor(n * 0.2)))::INT AS sb FROM w),
m AS (SELECT *, list_avg(v[n-gw+1:n]) AS g0, list_avg(v[n-gw-gb+1:n-gw]) AS g1, list_avg(v[n-aw+1:n]) AS a0,
  list_avg(v[n-2*aw+1:n-aw]) AS a1, list_avg(v[n-3*aw+1:n-2*aw]) AS a2, list_avg(v[n-sw+1:n]) AS s0,
  list_avg(v[n-sw-sb+1:n-sw]) AS s1, list_avg(v[n-lw+1:n]) AS l0, list_avg(v[n-2*lw+1:n-lw]) AS l1,
  v[n] AS latest, list_max(v) AS peak, list_min(v) AS low, list_stddev_pop(v) AS sd,
  len(list_filter(v, lambda x: x >= mean * 0.72)) / n AS sustained FROM w2),
sig AS (SELECT *, {_r1(_pc('g0', 'g1'))} AS growth_rate, {_r1(_pc('a0', 'a1') + ' - ' + _pc('a1', 'a2'))} AS acceleration,
  {_r1(_pc('latest', 's1'))} AS spike_magnitude,
  {_r1("least(100, greatest(0, ((1 - least(1.35, greatest(0, sd / greatest(mean, 1))) / 1.35) * 0.38 + sustained * 0.4 + least(1, greatest(0, low / greatest(mean, 1))) * 0.22) * 100))")} AS persistence
  FROM m)"""


@query(
    "series_shape_signals",
    f"""WITH {week_sql()}, {_SHAPE} SELECT subject, CAST(n AS BIGINT) AS n, {r6('latest')} AS latest, {r6('peak')} AS peak, {r6('growth_rate')} AS growth_rate,
    {r6('acceleration')} AS acceleration, {r6('spike_magnitude')} AS spike_magnitude, {r6('persistence')} AS persistence,
    spike_magnitude >= 22 AND latest > s0 * 1.06 AS has_spike,
    CASE WHEN growth_rate <= -5 OR (acceleration <= -2.2 AND l0 < l1 * 0.985 AND latest < peak * 0.88) THEN 'Declining'
     WHEN (growth_rate >= 8 AND acceleration >= 0.9 AND latest < peak * 0.985)
       OR (growth_rate >= 5 AND latest / greatest(l1, 1) >= 1.35 AND l0 > l1 * 1.2) THEN 'Expanding'
     WHEN latest >= peak * 0.94 AND growth_rate >= -1.5 AND growth_rate <= 5.5 AND abs(acceleration) <= 2.2 THEN 'Established'
     WHEN (latest >= peak * 0.94 AND acceleration < -0.7) OR (growth_rate >= 0 AND acceleration < -1.6) THEN 'Fading'
     WHEN growth_rate > 1.5 OR acceleration > 0.5 THEN 'Emerging'
     WHEN l0 < l1 * 0.985 THEN 'Declining' ELSE 'Established' END AS lifecycle FROM sig""",
)
def _(spark, sf):
    return se.shape_signals(week(spark, sf), ["subject"])


_PLAT = f"""{week_sql('subject, event_type')}, pk AS (SELECT subject, event_type, list(value ORDER BY i) AS v FROM series GROUP BY 1, 2),
psig AS (SELECT subject, event_type, list_avg(v[1:20]) * 0.72 + list_max(v[1:20]) * 0.28 AS early_score, list_max(v) AS peak,
  CAST(list_position(list_transform(v, lambda x: x >= list_max(v) * 0.62), true) - 1 AS BIGINT) AS first_strong,
  list_avg(v[-14:]) - list_avg(v[-28:-15]) AS delta, {_r1(_pc('list_avg(v[-14:])', 'list_avg(v[-28:-15])'))} AS delta_pct FROM pk)"""


def _platform_signals(spark, sf):
    return se.platform_signals(week(spark, sf, ("subject", "event_type")), ["subject"], "event_type")


@query(
    "series_platform_signals",
    f"""WITH {_PLAT} SELECT subject, event_type, {r6('early_score')} AS early_score, {r6('peak')} AS peak, first_strong, {r6('delta')} AS delta,
    {r6('delta_pct')} AS delta_pct FROM psig""",
)
def _(spark, sf):
    return _platform_signals(spark, sf).select("subject", "event_type", "early_score", "peak", "first_strong", "delta", "delta_pct")


@query(
    "series_origin_platform",
    f"""WITH {_PLAT} SELECT subject, event_type AS origin_platform, {r6('early_score')} AS early_score FROM psig
    QUALIFY row_number() OVER (PARTITION BY subject ORDER BY round(early_score, 9) DESC, event_type) = 1""",
)
def _(spark, sf):
    sig = _platform_signals(spark, sf).withColumn("early_score", F.round("early_score", 9))
    return se.origin_platform(sig, ["subject"], "event_type")


@query(
    "series_migration_path",
    f"""WITH {_PLAT} SELECT subject, string_agg(event_type, '|' ORDER BY first_strong, peak DESC, event_type) AS path FROM psig GROUP BY 1""",
)
def _(spark, sf):
    return se.migration_path(_platform_signals(spark, sf), ["subject"], "event_type")


@query(
    "series_attention_drivers",
    f"""WITH {_PLAT}, src AS (SELECT *, max(delta > 1e-9) OVER (PARTITION BY subject) AS any_up FROM psig),
    kept AS (SELECT *, sum(greatest(delta, 0.01)) OVER (PARTITION BY subject) AS total FROM src WHERE NOT any_up OR delta > 1e-9)
    SELECT subject, event_type, row_number() OVER (PARTITION BY subject ORDER BY round(delta, 9) DESC, event_type) AS driver_rank,
     {r6(_r1('greatest(delta, 0.01) / total * 100'))} AS contribution_pct, {r6('delta_pct')} AS delta_pct FROM kept
    QUALIFY driver_rank <= 3""",
)
def _(spark, sf):
    sig = _platform_signals(spark, sf).withColumn("delta", F.round("delta", 9))
    return se.attention_drivers(sig, ["subject"], "event_type")


@query(
    "series_window_totals",
    f"""WITH {week_sql()}, pk AS (SELECT subject, list(value ORDER BY i) AS v FROM series GROUP BY 1)
    SELECT subject, {r6('list_sum(v[-12:])')} AS current_total, {r6('list_sum(v[-24:-13])')} AS previous_total FROM pk""",
)
def _(spark, sf):
    return se.window_totals(week(spark, sf), ["subject"])


@query(
    "series_previous_day",
    f"""WITH {st.ACTIONS_SQL} SELECT k % 10 AS subject, {r6('sum(value)')} AS previous_day FROM actions
    WHERE ts >= TIMESTAMP '2024-01-28 12:00:00' AND ts < TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1""",
)
def _(spark, sf):
    return se.previous_day_total(items(spark, sf), ["subject"], "ts", F.col("value"), st.as_of_lit())


def topic_totals(spark, sf):
    return items(spark, sf).groupBy("subject").agg(
        F.count(F.lit(1)).alias("total_mentions"), F.count_distinct("event_id").alias("unique_posts"),
        F.count_distinct("user_id").alias("unique_authors"),
    )


TOTALS_SQL = "totals AS (SELECT subject, count(*) AS m, count(DISTINCT event_id) AS p, count(DISTINCT user_id) AS a FROM items GROUP BY 1)"
_DP = lambda c, p: f"CASE WHEN {p} <= 0 THEN CASE WHEN {c} > 0 THEN 100.0 ELSE 0 END ELSE ({c} - {p}) / {p} * 100 END"
TRUST_SQL = f"""parts AS (SELECT subject, sum(value) FILTER (WHERE i < 168) AS ph, sum(value) FILTER (WHERE i >= 168) AS rh,
  sum(value) FILTER (WHERE i >= 168 AND i < 252) AS pq, sum(value) FILTER (WHERE i >= 252) AS rq,
  count(*) FILTER (WHERE observed) AS ob, count(*) FILTER (WHERE value > 0) AS nz,
  count(*) FILTER (WHERE observed AND i < 168) / 168 AS c_prev, count(*) FILTER (WHERE observed AND i >= 168) / 168 AS c_recent,
  count(*) FILTER (WHERE observed AND i >= 168 AND i < 252) / 84 AS c_aprev, count(*) FILTER (WHERE observed AND i >= 252) / 84 AS c_arecent
  FROM series GROUP BY 1),
t0 AS (SELECT *, ob / 336 AS c_all, ((m >= 12)::INT + (p >= 5)::INT + (a >= 4)::INT >= 2 AND m >= 6) AS supported,
  (least(1, m / 12.0::DOUBLE) + least(1, p / 5.0::DOUBLE) + least(1, a / 4.0::DOUBLE)) / 3 AS sr FROM totals JOIN parts USING (subject)),
t1 AS (SELECT *, supported AND c_all >= 0.5 AND nz >= 4 AND c_prev >= 0.6 AND c_recent >= 0.6 AS gt,
  supported AND c_all >= 0.5 AND nz >= 4 AND c_aprev >= 0.6 AND c_arecent >= 0.6 AS at_,
  supported AND c_all >= 0.5 AND nz >= 4 AND c_arecent >= 0.6 AS vt FROM t0),
t2 AS (SELECT *, CASE WHEN gt THEN least(sr, c_all, c_prev, c_recent) ELSE 0 END AS gts,
  CASE WHEN at_ THEN least(sr, c_all, c_aprev, c_arecent) ELSE 0 END AS ats,
  CASE WHEN vt THEN least(sr, c_all, c_arecent) ELSE 0 END AS vts FROM t1),
trust AS (SELECT *, greatest(gts, ats, vts) AS mts,
  CASE WHEN gt THEN least(400, greatest(-100, least(400, greatest(-100, {_DP('rh', 'ph')})) * gts)) ELSE 0 END AS growth_rate,
  CASE WHEN at_ THEN least(400, greatest(-100, least(400, greatest(-100, {_DP('rq', 'pq')})) * ats)) ELSE 0 END AS acceleration,
  CASE WHEN vt THEN least(1000, rq / 42.0 * greatest(0.45, vts)) ELSE least(1000, m / 168.0) END AS velocity FROM t2)"""


@query(
    "series_halves_and_trust",
    f"""WITH {week_sql()}, {TOTALS_SQL}, {TRUST_SQL} SELECT subject, m AS total_mentions, ob AS observed_buckets, nz AS non_zero_buckets,
    gt AS growth_trusted, at_ AS acceleration_trusted, vt AS velocity_trusted, {r6('mts')} AS momentum_trust, {r6('growth_rate')} AS growth_rate,
    {r6('acceleration')} AS acceleration, {r6('velocity')} AS velocity FROM trust""",
)
def _(spark, sf):
    return se.halves_and_trust(week(spark, sf), topic_totals(spark, sf), "subject", 336, 30).select(
        "subject", "total_mentions", "observed_buckets", "non_zero_buckets", "growth_trusted", "acceleration_trusted",
        "velocity_trusted", "momentum_trust", "growth_rate", "acceleration", "velocity",
    )


@query(
    "series_live_window",
    f"""WITH {_DAILY}, {_STEPS.replace('ELSE 300 END', 'ELSE 1800 END')}, m AS (SELECT user_id, CAST(min(epoch(day)) AS BIGINT) AS f, CAST(max(epoch(day)) AS BIGINT) AS l,
      CAST(max(epoch(day)) FILTER (WHERE value > 0) AS BIGINT) AS d, count(*) FILTER (WHERE epoch(day) >= {AS_OF - 604800} AND epoch(day) <= {AS_OF}) AS inside
      FROM daily GROUP BY 1)
    SELECT user_id, inside AS points_inside, {ts('to_timestamp(l)::TIMESTAMP')} AS latest_point_at, {ts('to_timestamp(d)::TIMESTAMP')} AS latest_data_at,
      CAST(greatest(0, floor(({AS_OF} - l) / 60 + 0.5)) AS BIGINT) AS stale_gap_minutes,
      CAST(greatest(0, ceil(({AS_OF} - l) / step)) AS BIGINT) AS trailing_gap_buckets,
      CAST(greatest(1, floor(step / 60 + 0.5)) AS BIGINT) AS bucket_minutes,
      greatest(step, l - f + step) >= 604800 * 0.9 AS covers_window FROM m JOIN steps USING (user_id)""",
)
def _(spark, sf):
    return se.clip_to_window(daily(spark, sf), ["user_id"], "day", "value", AS_OF, "7d")


@query(
    "series_overlay",
    f"""WITH {week_sql('subject, event_type')} SELECT subject, CAST(i AS BIGINT) AS i, {r6('floor(sum(value) * 10 + 0.5) / 10')} AS value
    FROM series WHERE event_type IN ('view', 'click') GROUP BY 1, 2""",
)
def _(spark, sf):
    all_series = week(spark, sf, ("subject", "event_type"))
    return se.add_series(all_series.where("event_type = 'view'"), all_series.where("event_type = 'click'"), ["subject"])


@query(
    "series_fallback_choice",
    f"""WITH {week_sql('subject, event_type', value="CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END")}, p AS (SELECT subject, i, sum(value) FILTER (WHERE event_type = 'view') AS a,
      sum(value) FILTER (WHERE event_type = 'click') AS b FROM series GROUP BY 1, 2)
    SELECT subject, CAST(i AS BIGINT) AS i, {r6('CASE WHEN sum(coalesce(a, 0)) OVER (PARTITION BY subject) > 0 THEN coalesce(a, 0) ELSE coalesce(b, 0) END')} AS value FROM p""",
)
def _(spark, sf):
    all_series = se.bucket_ends(items(spark, sf), ["subject", "event_type"], "ts", F.when(F.col("k") % 2 == 0, 1).otherwise(0), AS_OF, "7d")
    return se.prefer_non_empty(all_series.where("event_type = 'view'"), all_series.where("event_type = 'click'"), ["subject"])


@query(
    "series_leadership",
    f"""WITH {week_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY value DESC, subject) AS p FROM series WHERE value > 0)
    SELECT subject, {r6('sum(value * (6 - p))')} AS score, count(*) AS buckets_led, {r6('max(value)')} AS peak FROM r WHERE p <= 5 GROUP BY 1""",
)
def _(spark, sf):
    return se.leadership(week(spark, sf), "subject")


@query(
    "series_all_topics_history",
    f"""WITH {week_sql()} SELECT {ts('bucket_ts')} AS bucket_ts, {r6('sum(value)')} AS value FROM series GROUP BY bucket_ts""",
)
def _(spark, sf):
    return week(spark, sf).groupBy("bucket_ts").agg(F.sum("value").alias("value"))


_REPLAY_W = "CASE event_type WHEN 'view' THEN 4 WHEN 'purchase' THEN 4 WHEN 'error' THEN 3 WHEN 'click' THEN 2 ELSE 1 END"


@query(
    "replay_series",
    f"""WITH {week_sql('subject', 288, 300, _REPLAY_W)} SELECT subject, CAST(i AS BIGINT) AS i, {r6('value')} AS value, {ts('bucket_ts')} AS bucket_ts FROM series""",
)
def _(spark, sf):
    # roots (view) and quotes (purchase) weigh 4, replies (error) 3, reposts (click) 2, likes (signup) 1
    return se.bucket_ends(items(spark, sf), ["subject"], "ts", F.expr(_REPLAY_W), AS_OF, "24h").drop("observed")
