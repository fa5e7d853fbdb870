"""Minute, hour, day, rolling and cluster rollups."""

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.mentions import mention_facts
from tidegauge.catalog.sqlkit import DAY_TOTALS, MENTIONS, MINUTES, SENTIMENT_COUNTS, big, initcap, plain_minute_mentions, r6, ts
from tidegauge.operators import mentions as mn, rollups as ru
from tidegauge.plans import standins as st


def _posts(spark, sf):
    return st.processed_posts(spark, sf).withColumn("created_at", F.col("source_created_at"))


for _unit in ("minute", "hour"):
    _extra = (
        """, CAST(count(*) FILTER (WHERE is_reply) AS BIGINT) AS reply_count, CAST(count(*) FILTER (WHERE is_repost) AS BIGINT) AS repost_count,
        CAST(count(*) FILTER (WHERE has_link) AS BIGINT) AS link_post_count""" if _unit == "minute" else ""
    )
    query(
        f"platform_metrics_{_unit}",
        f"""WITH {st.ACTIONS_SQL}, {st.PROCESSED_SQL} SELECT {ts(f"date_trunc('{_unit}', source_created_at)")} AS bucket_start, platform,
        count(*) AS mention_count, count(DISTINCT author_id) AS unique_authors{_extra} FROM processed
        GROUP BY date_trunc('{_unit}', source_created_at), platform""",
    )(lambda spark, sf, unit=_unit: ru.platform_metrics(_posts(spark, sf), unit))


@query(
    "topic_minutes",
    f"""WITH {plain_minute_mentions()}, agg AS (SELECT bucket_minute, platform, normalized_topic AS topic_key, count(*) AS mention_count,
      count(DISTINCT nullif(author_id, '')) AS unique_authors, count(DISTINCT raw_post_id) AS unique_posts,
      sum(quality_score) AS total_quality_score, avg(quality_score) AS avg_quality_score,
      {big('min(topic_priority)')} AS best_topic_priority, count(*) FILTER (WHERE is_repost) AS repost_count,
      count(*) FILTER (WHERE is_reply) AS reply_count, count(*) FILTER (WHERE has_link) AS link_post_count,
      count(*) FILTER (WHERE mood = 'positive') AS positive_count, count(*) FILTER (WHERE mood = 'neutral') AS neutral_count,
      count(*) FILTER (WHERE mood = 'negative') AS negative_count FROM counted GROUP BY 1, 2, 3),
    totals AS (SELECT platform, topic_key FROM agg GROUP BY 1, 2 HAVING sum(mention_count) >= 2)
    SELECT {ts('bucket_minute')} AS bucket_minute, platform, topic_key, mention_count, unique_authors, unique_posts,
      {r6('total_quality_score')} AS total_quality_score, {r6('avg_quality_score')} AS avg_quality_score, best_topic_priority,
      repost_count, reply_count, link_post_count, positive_count, neutral_count, negative_count,
      CASE WHEN topic_key = 'no kings' THEN 'No Kings' ELSE {initcap('topic_key')} END AS topic_display,
      positive_count - negative_count AS sentiment_net,
      {r6('round(CAST((positive_count - negative_count)::DOUBLE / mention_count AS DOUBLE), 4)')} AS sentiment_score
    FROM agg JOIN totals USING (platform, topic_key)""",
)
def _(spark, sf):
    rows = mn.minute_mentions(st.post_topics(spark, sf), st.processed_posts(spark, sf), mn.alias_rules(spark))
    return ru.topic_minutes(rows)


@query(
    "topic_minutes_final",
    f"""WITH {MINUTES} SELECT {ts('bucket_minute')} AS bucket_minute, platform, topic_key, mention_count, unique_posts, unique_authors,
    positive_count, neutral_count, negative_count, {r6('avg_topic_confidence')} AS avg_topic_confidence FROM minutes""",
)
def _(spark, sf):
    return ru.final_minutes(mention_facts(spark, sf))


_DAY_COLS = f"""CAST(day AS VARCHAR) AS day, topic_key, topic_label, platform_count, total_mentions, unique_posts, unique_authors,
 positive_count, neutral_count, negative_count, {r6('avg_topic_confidence')} AS avg_topic_confidence,
 {ts('first_seen_at')} AS first_seen_at, {ts('last_seen_at')} AS last_seen_at"""


def day_totals(spark, sf):
    facts = mention_facts(spark, sf)
    return ru.day_totals(ru.final_minutes(facts), facts)


@query("topic_day_totals", f"WITH {DAY_TOTALS} SELECT {_DAY_COLS} FROM day_totals")
def _(spark, sf):
    return day_totals(spark, sf)


@query(
    "topic_day_leaders",
    f"WITH {DAY_TOTALS} SELECT {_DAY_COLS} FROM day_totals ORDER BY total_mentions DESC, unique_posts DESC, day_totals.day, topic_key LIMIT 250",
)
def _(spark, sf):
    return day_totals(spark, sf).orderBy(F.desc("total_mentions"), F.desc("unique_posts"), "day", "topic_key").limit(250)


_W0, _W1 = "TIMESTAMP '2024-01-29 12:00:00'", "TIMESTAMP '2024-01-30 12:00:00'"


def window_bounds():
    return st.as_of_lit("2024-01-29 12:00:00"), st.as_of_lit("2024-01-30 12:00:00")


@query(
    "topic_rolling_24h",
    f"""WITH {MENTIONS}, src AS (SELECT * FROM mentions WHERE event_timestamp >= {_W0} AND event_timestamp < {_W1} AND topic_confidence >= 0.34),
    lab AS (SELECT topic_key, topic_label FROM src GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY topic_key
      ORDER BY count(*) DESC, length(topic_label) DESC, topic_label) = 1),
    agg AS (SELECT topic_key, count(DISTINCT platform) AS platform_count, count(*) AS total_mentions,
      count(DISTINCT raw_post_id) AS unique_posts, count(DISTINCT author_id) AS unique_authors, {SENTIMENT_COUNTS},
      avg(topic_confidence) AS avg_c, min(event_timestamp) AS f, max(event_timestamp) AS l FROM src GROUP BY 1 HAVING count(*) >= 2)
    SELECT topic_key, topic_label, platform_count, total_mentions, unique_posts, unique_authors, positive_count, neutral_count,
      negative_count, {r6('avg_c')} AS avg_topic_confidence, {ts('f')} AS first_seen_at, {ts('l')} AS last_seen_at
    FROM agg LEFT JOIN lab USING (topic_key)""",
)
def _(spark, sf):
    return ru.window_exact(mention_facts(spark, sf), *window_bounds())


@query(
    "topic_window_totals",
    f"""WITH {MINUTES}, lab AS (SELECT topic_key, topic_label FROM mentions WHERE event_timestamp >= {_W0} AND event_timestamp <= {_W1}
      AND topic_confidence >= 0.34 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY topic_key
      ORDER BY count(*) DESC, length(topic_label) DESC, topic_label) = 1)
    SELECT m.topic_key, coalesce(any_value(topic_label), {initcap('m.topic_key')}) AS topic_label, count(DISTINCT platform) AS platform_count,
      {big('sum(mention_count)')} AS total_mentions, {big('sum(unique_posts)')} AS unique_posts, {big('sum(unique_authors)')} AS unique_authors,
      {big('sum(positive_count)')} AS positive_count, {big('sum(neutral_count)')} AS neutral_count, {big('sum(negative_count)')} AS negative_count,
      {ts('min(bucket_minute)')} AS first_seen_at, {ts('max(bucket_minute)')} AS last_seen_at
    FROM minutes m LEFT JOIN lab USING (topic_key) WHERE bucket_minute >= {_W0} AND bucket_minute <= {_W1}
    GROUP BY m.topic_key HAVING sum(mention_count) >= 2
    ORDER BY total_mentions DESC, unique_posts DESC, unique_authors DESC, m.topic_key LIMIT 250""",
)
def _(spark, sf):
    facts = mention_facts(spark, sf)
    return ru.window_from_minutes(ru.final_minutes(facts), facts, *window_bounds(), 250)


# cluster mapping: topic families share a cluster key (first word of the topic key)
_MAPPING_SQL = "mapping AS (SELECT DISTINCT topic_key AS raw_topic_key, string_split(topic_key, ' ')[1] AS cluster_key FROM mentions)"


def cluster_mapping(facts):
    return facts.select(F.col("topic_key").alias("raw_topic_key"), F.split("topic_key", " ")[0].alias("cluster_key")).distinct()


_CLUSTER_POSTS = f"""{MENTIONS}, {_MAPPING_SQL}, cluster_posts AS (SELECT cluster_key, m.* FROM mentions m
  JOIN mapping ON raw_topic_key = topic_key WHERE event_timestamp >= {_W0} AND event_timestamp <= {_W1} AND topic_confidence >= 0.34
  QUALIFY row_number() OVER (PARTITION BY cluster_key, platform, raw_post_id ORDER BY topic_confidence DESC, event_timestamp DESC, topic_key) = 1)"""
_CLUSTER_TOTALS = f"""cluster_totals AS (SELECT cluster_key AS topic_key, count(*) AS total_mentions, count(*) AS unique_posts,
  count(DISTINCT author_id) AS unique_authors, {SENTIMENT_COUNTS}, count(DISTINCT platform) AS platform_count,
  min(event_timestamp) AS first_seen_at, max(event_timestamp) AS last_seen_at FROM cluster_posts GROUP BY 1)"""


@query(
    "cluster_totals",
    f"""WITH {_CLUSTER_POSTS}, {_CLUSTER_TOTALS} SELECT * REPLACE ({ts('first_seen_at')} AS first_seen_at, {ts('last_seen_at')} AS last_seen_at)
    FROM cluster_totals""",
)
def _(spark, sf):
    facts = mention_facts(spark, sf)
    return ru.cluster_totals(ru.cluster_posts(facts, cluster_mapping(facts), *window_bounds()))


@query(
    "cluster_series_5m",
    f"""WITH {MENTIONS}, {_MAPPING_SQL}, p AS (SELECT DISTINCT cluster_key, platform, raw_post_id,
      time_bucket(INTERVAL 5 MINUTE, event_timestamp) AS b FROM mentions JOIN mapping ON raw_topic_key = topic_key
      WHERE event_timestamp >= {_W0} AND event_timestamp <= {_W1} AND topic_confidence >= 0.34)
    SELECT cluster_key AS topic_key, {ts('b')} AS bucket_5m, count(*) AS interactions FROM p GROUP BY cluster_key, b""",
)
def _(spark, sf):
    facts = mention_facts(spark, sf)
    return ru.cluster_series(facts, cluster_mapping(facts), *window_bounds())


@query(
    "cluster_total_override",
    f"""WITH {_CLUSTER_POSTS}, {_CLUSTER_TOTALS}, summed AS (SELECT string_split(topic_key, ' ')[1] AS topic_key, count(*) AS total_mentions,
      count(*) AS unique_posts FROM mentions WHERE topic_confidence >= 0.34 GROUP BY 1)
    SELECT topic_key, coalesce(c.total_mentions, s.total_mentions) AS total_mentions, coalesce(c.unique_posts, s.unique_posts) AS unique_posts
    FROM summed s LEFT JOIN cluster_totals c USING (topic_key) WHERE coalesce(c.total_mentions, s.total_mentions) >= 2""",
)
def _(spark, sf):
    facts = mention_facts(spark, sf)
    exact = ru.cluster_totals(ru.cluster_posts(facts, cluster_mapping(facts), *window_bounds()))
    summed = ru.confident(facts).groupBy(F.split("topic_key", " ")[0].alias("topic_key")).agg(
        F.count(F.lit(1)).alias("total_mentions"), F.count(F.lit(1)).alias("unique_posts"),
        *[F.lit(0).cast("long").alias(x) for x in ("unique_authors", "positive_count", "neutral_count", "negative_count", "platform_count")],
        F.min("event_timestamp").alias("first_seen_at"), F.max("event_timestamp").alias("last_seen_at"),
    )
    return ru.override_totals(summed, exact).select("topic_key", "total_mentions", "unique_posts")


@query(
    "topic_day_series_5m",
    f"""WITH {DAY_TOTALS}, leaders AS (SELECT day, topic_key, topic_label FROM day_totals
      QUALIFY row_number() OVER (PARTITION BY day ORDER BY total_mentions DESC, topic_key) <= 300),
    grid AS (SELECT day, topic_key, topic_label, unnest(generate_series(CAST(day AS TIMESTAMP),
      CAST(day AS TIMESTAMP) + INTERVAL 1435 MINUTE, INTERVAL 5 MINUTE)) AS b FROM leaders),
    seen AS (SELECT topic_key, time_bucket(INTERVAL 5 MINUTE, bucket_minute) AS b, sum(mention_count) AS v FROM minutes GROUP BY 1, 2)
    SELECT CAST(g.day AS VARCHAR) AS day, g.topic_key, g.topic_label, {ts('g.b')} AS bucket_5m, {big('coalesce(v, 0)')} AS interactions,
      {big('sum(coalesce(v, 0)) OVER (PARTITION BY g.day, g.topic_key ORDER BY g.b)')} AS cumulative_interactions
    FROM grid g LEFT JOIN seen s ON s.topic_key = g.topic_key AND s.b = g.b""",
)
def _(spark, sf):
    facts = mention_facts(spark, sf)
    minutes = ru.final_minutes(facts)
    return ru.day_series(minutes, ru.day_totals(minutes, facts))
