"""Mention building, gates, merges and clean-up."""

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import CANDIDATES, MENTIONS, INFORMATIVE, arr, big, count_in, plain_minute_mentions, r6, ts
from tidegauge import fixed
from tidegauge.operators import mentions as mn
from tidegauge.plans import standins as st


def mention_facts(spark, sf):
    return mn.sync_mentions(st.post_topics(spark, sf), st.processed_posts(spark, sf), mn.alias_rules(spark))


_COLS = f"""raw_post_id, processed_post_id, platform, topic_key, topic_label, {ts('event_timestamp')} AS event_timestamp,
 {ts('ingested_at')} AS ingested_at, author_id, sentiment_label, {r6('quality_score')} AS quality_score,
 {r6('topic_confidence')} AS topic_confidence, is_repost, is_reply, has_link"""


@query("topic_mentions", f"WITH {MENTIONS} SELECT {_COLS} FROM mentions")
def _(spark, sf):
    return mention_facts(spark, sf)


@query(
    "topic_confidence_profile",
    f"""WITH {CANDIDATES} SELECT raw_post_id, topic_type, topic_key, topic_label, n AS token_count, weak AS weak_count,
    noise AS noise_count, number_n AS number_count, url_n AS url_count, informative AS informative_count,
    {r6('topic_confidence')} AS topic_confidence FROM scored""",
)
def _(spark, sf):
    df = mn.with_processed(st.post_topics(spark, sf), st.processed_posts(spark, sf))
    p = F.col("profile")
    return mn.score(mn.canonicalise(df, mn.alias_rules(spark))).select(
        "raw_post_id", "topic_type", "topic_key", "topic_label", p["n"].alias("token_count"), p["weak"].alias("weak_count"),
        p["noise"].alias("noise_count"), p["number"].alias("number_count"), p["url"].alias("url_count"),
        p["informative"].alias("informative_count"), "topic_confidence",
    )


@query(
    "mention_merge",
    f"""WITH {MENTIONS}, older AS (SELECT * FROM mentions WHERE raw_post_id % 2 = 0),
    newer AS (SELECT raw_post_id, platform, topic_key, CASE WHEN raw_post_id % 5 = 0 THEN NULL ELSE topic_label END AS topic_label,
      event_timestamp - INTERVAL 1 HOUR AS event_timestamp, ingested_at + INTERVAL 1 HOUR AS ingested_at,
      CASE WHEN raw_post_id % 7 = 0 THEN NULL ELSE author_id END AS author_id, 'neutral' AS sentiment_label,
      quality_score / 2 AS quality_score, topic_confidence - 0.1 AS topic_confidence FROM mentions WHERE raw_post_id % 3 = 0)
    SELECT coalesce(o.raw_post_id, n.raw_post_id) AS raw_post_id, coalesce(o.platform, n.platform) AS platform,
      coalesce(o.topic_key, n.topic_key) AS topic_key, coalesce(n.topic_label, o.topic_label) AS topic_label,
      {ts('greatest(o.event_timestamp, n.event_timestamp)')} AS event_timestamp,
      {ts('greatest(o.ingested_at, n.ingested_at)')} AS ingested_at, coalesce(n.author_id, o.author_id) AS author_id,
      coalesce(n.sentiment_label, o.sentiment_label) AS sentiment_label,
      {r6('coalesce(n.quality_score, o.quality_score)')} AS quality_score,
      {r6('greatest(o.topic_confidence, n.topic_confidence)')} AS topic_confidence
    FROM older o FULL JOIN newer n ON o.raw_post_id = n.raw_post_id AND o.platform = n.platform AND o.topic_key = n.topic_key""",
)
def _(spark, sf):
    facts = mention_facts(spark, sf)
    newer = facts.where("raw_post_id % 3 = 0").selectExpr(
        "raw_post_id", "processed_post_id", "platform", "topic_key", "IF(raw_post_id % 5 = 0, NULL, topic_label) AS topic_label",
        "event_timestamp - INTERVAL 1 HOUR AS event_timestamp", "ingested_at + INTERVAL 1 HOUR AS ingested_at",
        "IF(raw_post_id % 7 = 0, NULL, author_id) AS author_id", "'neutral' AS sentiment_label",
        "quality_score / 2 AS quality_score", "topic_confidence - 0.1D AS topic_confidence", "is_repost", "is_reply", "has_link",
    )
    return mn.merge_mentions(facts.where("raw_post_id % 2 = 0"), newer).select(
        "raw_post_id", "platform", "topic_key", "topic_label", "event_timestamp", "ingested_at", "author_id",
        "sentiment_label", "quality_score", "topic_confidence",
    )


_bad_listed = arr(fixed.WEAK_WORDS + fixed.TOPIC_NOISE + fixed.NUMBER_WORDS + fixed.URL_DEBRIS)
_GARBAGE = f"""(trim(topic_key) = '' OR topic_key IN ('all','general','digit') OR coalesce(topic_confidence, 0) < 0.20
  OR regexp_matches(topic_key, '(^| )([a-z0-9]+bot)( |$)') OR regexp_matches(topic_key, '(^| )(https?|www|com|co|t|ly|amp)( |$)')
  OR regexp_matches(topic_key, '(area|forecast|discussion).*(afd|airnow|aqi)') OR regexp_matches(topic_key, '(additional|details) here')
  OR (len(string_split(topic_key, ' ')) = 1 AND list_contains({_bad_listed}, topic_key))
  OR {count_in("string_split(topic_key, ' ')", fixed.NUMBER_WORDS)} = len(string_split(topic_key, ' '))
  OR {INFORMATIVE} = 0)"""


@query(
    "mention_garbage_cleanup",
    f"WITH {CANDIDATES} SELECT topic_key, {_GARBAGE} AS is_garbage, count(*) AS n FROM scored GROUP BY 1, 2",
)
def _(spark, sf):
    df = mn.with_processed(st.post_topics(spark, sf), st.processed_posts(spark, sf))
    scored = mn.score(mn.canonicalise(df, mn.alias_rules(spark)))
    return scored.groupBy("topic_key", mn.is_garbage().alias("is_garbage")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "minute_mentions_with_fallback",
    f"""WITH {plain_minute_mentions()} SELECT raw_post_id, platform, normalized_topic, topic_priority, mood AS sentiment_label,
    {ts('bucket_minute')} AS bucket_minute, {r6('quality_score')} AS quality_score FROM counted""",
)
def _(spark, sf):
    return mn.minute_mentions(st.post_topics(spark, sf), st.processed_posts(spark, sf), mn.alias_rules(spark)).select(
        "raw_post_id", "platform", "normalized_topic", "topic_priority", "sentiment_label", "bucket_minute", "quality_score"
    )


@query("text_topic_totals")
def _(spark, sf):
    """The whole chain: texts -> topic candidates -> mention facts -> minute buckets -> day totals."""
    from tidegauge.functions import text as tx
    from tidegauge.operators import rollups as ru, topics as tp
    from tidegauge.session import materialise

    at = st.as_of_lit() - F.make_interval(mins=(F.col("doc_id") % 2880).cast("int"))
    posts = st.raw_posts(spark, sf).withColumns({"at": at, "platform": F.lower("source")})
    found = tp.topic_candidates(posts, "doc_id", "text", F.lit(0.5))
    minute = F.date_trunc("minute", "at").cast("timestamp_ntz")
    topics = found.join(posts.select(F.col("doc_id").alias("d"), "at", "platform"), F.col("doc_id") == F.col("d")).select(
        F.col("doc_id").alias("raw_post_id"), F.col("doc_id").alias("processed_post_id"), "platform", F.col("at").alias("source_created_at"),
        minute.alias("bucket_minute"), "topic_text", "topic_type", F.col("topic").alias("normalized_topic"))
    processed = posts.select(
        F.col("doc_id").alias("raw_post_id"), F.col("doc_id").alias("processed_post_id"), "platform", (F.col("doc_id") % 97).cast("string").alias("author_id"),
        F.col("at").alias("source_created_at"), minute.alias("bucket_minute"), F.col("at").alias("processed_at"), tx.sentiment("text")["label"].alias("sentiment_label"),
        F.lit(0.5).alias("quality_score"), F.lit(False).alias("is_repost"), F.lit(False).alias("is_reply"), tx.urls("text").alias("urls"),
        F.lit(None).cast("string").alias("topic_key_candidate"))
    facts = materialise(mn.sync_mentions(topics, processed, mn.alias_rules(spark), platform="bluesky"), "mention-facts")  # written once, read by both rollups
    totals = ru.day_totals(ru.final_minutes(facts), facts)
    return totals.select(F.col("day").cast("string").alias("day"), "topic_key", "topic_label", "total_mentions", "unique_posts", "unique_authors")
