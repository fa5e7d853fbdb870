"""Rollups of posts and mentions: minute, hour, five-minute, day, rolling 24 h, arbitrary windows, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import fixed
from tidegauge.functions.basic import blank_to_null, count_true, floor_minutes
from tidegauge.functions.text import initcap
from tidegauge.operators.windows import best, modal_label
from tidegauge.session import materialise

TASK_ROWS = 100_000


def platform_metrics(posts: DataFrame, unit: str) -> DataFrame:
    """Post counts, distinct authors, replies, reposts and link posts per platform and minute or hour."""
    keyed = posts.where(F.col("created_at").isNotNull() & F.col("platform").isNotNull())
    aggs = [F.count(F.lit(1)).alias("mention_count"), F.count_distinct("author_id").alias("unique_authors")]
    if unit == "minute":
        aggs += [
            count_true(F.col("is_reply")).alias("reply_count"), count_true(F.col("is_repost")).alias("repost_count"),
            count_true(F.size("urls") > 0).alias("link_post_count"),
        ]
    return keyed.groupBy(F.date_trunc(unit, "created_at").alias("bucket_start"), "platform").agg(*aggs)


def _sentiments() -> list[Column]:
    return [count_true(F.col("sentiment_label") == s).alias(f"{s}_count") for s in ("positive", "neutral", "negative")]


def topic_minutes(mentions: DataFrame, min_total: int = 2) -> DataFrame:
    """Topic x platform x minute, for topics with at least ``min_total`` mentions on the platform.

    Mentions are dealt once, by minute and topic, to as many tasks as there are ``TASK_ROWS`` of them; authors and posts are values of two kinds, and both aggregations
    keep that dealing.  The rows of a post carry the measures."""
    rows = materialise(mentions, "minute-mentions")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    keys = ["bucket_minute", "platform", "topic_key"]
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.nullif("author_id", F.lit("")).alias("value")), F.struct(F.lit(1).alias("kind"), F.col("raw_post_id").cast("string").alias("value")))
    dealt = rows.withColumnRenamed("normalized_topic", "topic_key").repartition(tasks, *keys).select("*", F.inline(kinds))
    counts = {"mention_count": F.count(F.lit(1)), "scored": F.count("quality_score"), "repost_count": count_true(F.col("is_repost")), "reply_count": count_true(F.col("is_reply")),
              "link_post_count": count_true(F.col("has_link")), **{f"{s}_count": count_true(F.col("sentiment_label") == s) for s in ("positive", "neutral", "negative")}}
    values = dealt.groupBy(*keys, "kind", "value").agg(
        *[x.alias(name) for name, x in counts.items()], F.sum("quality_score").alias("quality"), F.min("topic_priority").alias("priority"))
    post = lambda x: F.when(F.col("kind") == 1, F.col(x))
    known = lambda i: F.count_if((F.col("kind") == i) & F.col("value").isNotNull())
    total = lambda x: F.sum(post(x)).alias(x)
    per_minute = values.groupBy(*keys).agg(
        total("mention_count"), known(0).alias("unique_authors"), known(1).alias("unique_posts"), F.sum(post("quality")).alias("total_quality_score"),
        F.try_divide(F.sum(post("quality")), F.sum(post("scored"))).alias("avg_quality_score"), F.min(post("priority")).alias("best_topic_priority"),
        *[total(x) for x in counts if x not in ("mention_count", "scored")])
    totals = per_minute.groupBy("platform", "topic_key").agg(F.sum("mention_count").alias("total")).where(
        F.col("total") >= min_total
    )
    net = F.col("positive_count") - F.col("negative_count")
    return (
        per_minute.join(totals.drop("total"), ["platform", "topic_key"], "left_semi")
        .withColumn("topic_display", F.when(F.col("topic_key") == "no kings", "No Kings").otherwise(initcap("topic_key")))
        .withColumn("sentiment_net", net)
        .withColumn("sentiment_score", F.round(net / F.col("mention_count"), 4))
    )


def confident(mentions: DataFrame) -> DataFrame:
    return mentions.where(F.coalesce("topic_confidence", F.lit(0.0)) >= fixed.MIN_CONFIDENCE)


def final_minutes(mentions: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Final minute buckets from mention facts; bounds are on whole minutes, so they prune date partitions."""
    src = confident(mentions)
    if start is not None:
        src = src.where(F.col("event_timestamp") >= start)
    if end is not None:
        src = src.where(F.col("event_timestamp") < end)
    return src.groupBy(
        F.date_trunc("minute", "event_timestamp").alias("bucket_minute"), "platform", "topic_key"
    ).agg(
        F.count(F.lit(1)).alias("mention_count"), F.count_distinct("raw_post_id").alias("unique_posts"),
        F.count_distinct(F.nullif("author_id", F.lit(""))).alias("unique_authors"), *_sentiments(),
        F.avg(F.coalesce("topic_confidence", F.lit(0.0))).alias("avg_topic_confidence"),
    )


def day_totals(minutes: DataFrame, mentions: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Day totals re-aggregated from minutes (distinct counts are summed, as stored), confidence weighted by mentions."""
    labels = modal_label(
        confident(mentions).withColumn("day", F.to_date("event_timestamp")), ["day", "topic_key"], "topic_label", "modal"
    )
    agg = (
        minutes.groupBy(F.to_date("bucket_minute").alias("day"), "topic_key").agg(
            F.collect_set("platform").alias("platforms"), F.sum("mention_count").alias("total_mentions"),
            F.sum("unique_posts").alias("unique_posts"), F.sum("unique_authors").alias("unique_authors"),
            *[F.sum(f"{s}_count").alias(f"{s}_count") for s in ("positive", "neutral", "negative")],
            F.sum(F.col("avg_topic_confidence") * F.col("mention_count")).alias("weighted"),
            F.min("bucket_minute").alias("first_seen_at"), F.max("bucket_minute").alias("last_seen_at"),
        )
        .where("total_mentions >= 2")
        .withColumn("platform_count", F.size("platforms"))
        .withColumn("avg_topic_confidence", F.col("weighted") / F.col("total_mentions"))
        .drop("platforms", "weighted")
    )
    return _label(agg.join(labels, ["day", "topic_key"], "left"), topics)


def _label(df: DataFrame, topics: DataFrame | None) -> DataFrame:
    if topics is not None:
        df = df.join(topics.select("topic_key", "canonical_label"), "topic_key", "left")
        first = [F.col("canonical_label")]
    else:
        first = []
    out = df.withColumn("topic_label", F.coalesce(*first, F.col("modal"), initcap("topic_key")))
    return out.drop("modal", "canonical_label")


def window_exact(mentions: DataFrame, start: Column, end: Column) -> DataFrame:
    """Totals of [start, end) from facts, with exact distinct counts."""
    src = confident(mentions).where((F.col("event_timestamp") >= start) & (F.col("event_timestamp") < end))
    labels = modal_label(src, ["topic_key"], "topic_label", "modal")
    agg = src.groupBy("topic_key").agg(
        F.count_distinct("platform").alias("platform_count"), F.count(F.lit(1)).alias("total_mentions"),
        F.count_distinct("raw_post_id").alias("unique_posts"),
        F.count_distinct(F.nullif("author_id", F.lit(""))).alias("unique_authors"), *_sentiments(),
        F.avg(F.coalesce("topic_confidence", F.lit(0.0))).alias("avg_topic_confidence"),
        F.min("event_timestamp").alias("first_seen_at"), F.max("event_timestamp").alias("last_seen_at"),
    ).where("total_mentions >= 2")
    return _label(agg.join(labels, "topic_key", "left"), None)


def window_from_minutes(minutes: DataFrame, mentions: DataFrame, start: Column, end: Column, limit: int | None) -> DataFrame:
    """Totals of [start, end] from minute buckets, best first."""
    src = minutes.where((F.col("bucket_minute") >= start) & (F.col("bucket_minute") <= end))
    labels = modal_label(
        confident(mentions).where((F.col("event_timestamp") >= start) & (F.col("event_timestamp") <= end)),
        ["topic_key"], "topic_label", "modal",
    )
    agg = src.groupBy("topic_key").agg(
        F.collect_set("platform").alias("platforms"), F.sum("mention_count").alias("total_mentions"),
        F.sum("unique_posts").alias("unique_posts"), F.sum("unique_authors").alias("unique_authors"),
        *[F.sum(f"{s}_count").alias(f"{s}_count") for s in ("positive", "neutral", "negative")],
        F.min("bucket_minute").alias("first_seen_at"), F.max("bucket_minute").alias("last_seen_at"),
    ).where("total_mentions >= 2").withColumn("platform_count", F.size("platforms")).drop("platforms")
    out = _label(agg.join(labels, "topic_key", "left"), None)
    if limit is None:
        return out
    return out.orderBy(
        F.desc("total_mentions"), F.desc("unique_posts"), F.desc("unique_authors"), F.asc("topic_key")
    ).limit(limit)


def cluster_posts(mentions: DataFrame, mapping: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row per cluster, platform and post: the most confident mention."""
    src = confident(mentions).where((F.col("event_timestamp") >= start) & (F.col("event_timestamp") <= end))
    joined = src.join(mapping, src.topic_key == mapping.raw_topic_key, "inner")
    return best(
        joined, ["cluster_key", "platform", "raw_post_id"],
        [F.coalesce("topic_confidence", F.lit(0.0)).desc(), F.col("event_timestamp").desc(), F.col("topic_key").asc()],
    )


def cluster_totals(posts: DataFrame) -> DataFrame:
    sentiment = F.coalesce(blank_to_null("sentiment_label"), F.lit("neutral"))
    return posts.groupBy(F.col("cluster_key").alias("topic_key")).agg(
        F.count(F.lit(1)).alias("total_mentions"), F.count(F.lit(1)).alias("unique_posts"),
        F.count_distinct(blank_to_null("author_id")).alias("unique_authors"),
        *[count_true(sentiment == s).alias(f"{s}_count") for s in ("positive", "neutral", "negative")],
        F.count_distinct("platform").alias("platform_count"),
        F.min("event_timestamp").alias("first_seen_at"), F.max("event_timestamp").alias("last_seen_at"),
    )


def cluster_series(mentions: DataFrame, mapping: DataFrame, start: Column, end: Column) -> DataFrame:
    """Distinct posts per cluster and five-minute bucket."""
    src = confident(mentions).where((F.col("event_timestamp") >= start) & (F.col("event_timestamp") <= end))
    return (
        src.join(mapping, src.topic_key == mapping.raw_topic_key, "inner")
        .select("cluster_key", "platform", "raw_post_id", floor_minutes("event_timestamp", 5).alias("bucket_5m"))
        .distinct().groupBy(F.col("cluster_key").alias("topic_key"), "bucket_5m").agg(F.count(F.lit(1)).alias("interactions"))
    )


def override_totals(rows: DataFrame, exact: DataFrame, min_mentions: int = 2) -> DataFrame:
    """Replace summed totals by exact ones where a cluster has them."""
    names = ["total_mentions", "unique_posts", "unique_authors", "positive_count", "neutral_count", "negative_count",
             "platform_count", "first_seen_at", "last_seen_at"]
    e = exact.select("topic_key", *[F.col(n).alias(f"x_{n}") for n in names])
    joined = rows.join(e, "topic_key", "left")
    fixed_cols = [F.coalesce(f"x_{n}", n).alias(n) for n in names]
    rest = [x for x in rows.columns if x not in names]
    return joined.select(*rest, *fixed_cols).where(F.col("total_mentions") >= min_mentions)


def day_series(minutes: DataFrame, totals: DataFrame, max_topics: int = 300, min_mentions: int = 2) -> DataFrame:
    """288 five-minute buckets with running totals for the top topics of every day.

    The limit comes before the expansion; the grid is generated per topic row, without a cross join."""
    from tidegauge.operators.windows import top_n

    leaders = top_n(
        totals.where(F.col("total_mentions") >= min_mentions), ["day"],
        [F.col("total_mentions").desc(), F.col("topic_key").asc()], max_topics,
    ).select("day", "topic_key", "topic_label")
    start = F.col("day").cast("timestamp_ntz")
    grid = leaders.withColumn(
        "bucket_5m",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(287)), lambda i: F.dateadd(F.col("day"), 0).cast("timestamp_ntz") + F.make_interval(mins=i * 5))),
    )
    seen = (
        minutes.withColumn("day", F.to_date("bucket_minute"))
        .join(leaders.select("day", "topic_key"), ["day", "topic_key"], "left_semi")
        .groupBy("day", "topic_key", floor_minutes("bucket_minute", 5).cast("timestamp_ntz").alias("bucket_5m"))
        .agg(F.sum("mention_count").alias("interactions"))
    )
    filled = grid.join(seen, ["day", "topic_key", "bucket_5m"], "left").withColumn(
        "interactions", F.coalesce("interactions", F.lit(0))
    )
    from pyspark.sql import Window

    run = Window.partitionBy("day", "topic_key").orderBy("bucket_5m").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("cumulative_interactions", F.sum("interactions").over(run))
