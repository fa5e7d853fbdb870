"""Topic mentions: canonical keys, confidence, quality gates, one row per post and topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge import fixed
from tidegauge.functions import text as tx
from tidegauge.functions.basic import barrier, blank_to_null, c, count_in, one_of, words
from tidegauge.operators.windows import best


def alias_rules(spark: SparkSession) -> DataFrame:
    rows = [(alias, key, label, float(conf), True) for alias, (key, label, conf) in sorted(tx.alias_lookup().items())]
    return spark.createDataFrame(
        rows, "alias_key string, canonical_key string, canonical_label string, confidence double, is_active boolean"
    )


def with_processed(topics: DataFrame, processed: DataFrame) -> DataFrame:
    """Topic rows left-joined with their post features."""
    facts = processed.select(
        "processed_post_id", F.col("source_created_at").alias("pp_created"), "processed_at", "author_id",
        "sentiment_label", "quality_score", "is_repost", "is_reply", (F.size("urls") > 0).alias("has_link"),
    )
    return topics.join(facts, "processed_post_id", "left")


def canonicalise(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias lookup on the stored spelling; unknown keys keep their own label."""
    active = aliases.where("is_active").select("alias_key", "canonical_key", "canonical_label", "confidence")
    keyed = barrier(df.withColumn("spelled", tx.topic_key_stored("normalized_topic")))
    joined = keyed.join(active, keyed.spelled == active.alias_key, "left")
    own = F.when(one_of(F.col("spelled"), fixed.ACRONYMS), F.upper("spelled")).otherwise(
        F.coalesce(blank_to_null("topic_text"), tx.initcap("spelled"))
    )
    return joined.select(
        *[F.col(x) for x in df.columns],
        F.coalesce("canonical_key", "spelled").alias("topic_key"),
        F.coalesce(F.col("canonical_label"), own).alias("topic_label"),
        F.coalesce("confidence", F.lit(0.0)).alias("alias_confidence"),
    )


def score(df: DataFrame) -> DataFrame:
    # each stage is computed once: the gate below reads these columns many times
    out = barrier(barrier(df).withColumn("profile", tx.token_profile("topic_key")))
    return out.withColumn(
        "topic_confidence",
        tx.stored_confidence("topic_key", "topic_type", "quality_score", "alias_confidence", "profile"),
    )


def gate(key: str = "topic_key", raw_text: str = "topic_text") -> Column:
    """True for mentions worth storing."""
    k, p = c(key), F.col("profile")
    return (
        (k != "") & ~k.isin(*fixed.BLOCKED_KEYS)
        & ~F.lower(F.coalesce(c(raw_text), F.lit(""))).like("digit:%in words:%")
        & (F.length(F.replace(k, F.lit(" "), F.lit(""))) >= 2)
        & ~k.rlike("^[0-9]+$")
        & ~k.rlike(fixed.LINK_WORD_PATTERN) & ~k.rlike(fixed.BOT_PATTERN)
        & ~k.rlike(fixed.WEATHER_PATTERN) & ~k.rlike(fixed.DETAIL_PATTERN)
        & (p["number"] < p["n"]) & (p["informative"] >= 1) & (p["url"] == 0)
        & (F.col("topic_confidence") >= tx.type_floor("topic_type"))
    )


def sync_mentions(topics: DataFrame, processed: DataFrame, aliases: DataFrame, since: Column | None = None, platform: str = "unknown") -> DataFrame:
    """post topics -> immutable mention facts, unique on (raw_post_id, platform, topic_key).  ``platform`` stands for a missing one."""
    if since is not None:
        topics = topics.where(F.col("source_created_at") >= since)
    df = with_processed(topics, processed)
    sentiment = F.col("sentiment_label")
    df = df.select(
        "raw_post_id", "processed_post_id",
        F.coalesce(blank_to_null("platform"), F.lit(platform)).alias("platform"),
        "normalized_topic", "topic_text", F.lower(F.coalesce("topic_type", F.lit("entity"))).alias("topic_type"),
        F.coalesce("source_created_at", "bucket_minute", "pp_created", "processed_at").alias("event_timestamp"),
        F.col("processed_at").alias("ingested_at"), blank_to_null("author_id").alias("author_id"),
        F.when(sentiment.isin("positive", "negative", "neutral"), sentiment).otherwise("neutral").alias("sentiment_label"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("quality_score", F.lit(0.0)))).alias("quality_score"),
        F.coalesce("is_repost", F.lit(False)).alias("is_repost"), F.coalesce("is_reply", F.lit(False)).alias("is_reply"),
        F.coalesce("has_link", F.lit(False)).alias("has_link"),
    )
    kept = barrier(score(canonicalise(df, aliases))).where(gate())
    rows = best(
        kept, ["raw_post_id", "platform", "topic_key"],
        [F.col("topic_confidence").desc(), F.col("quality_score").desc(), F.col("event_timestamp").desc(),
         F.col("topic_label").asc()],
    )
    return rows.select(
        "raw_post_id", "processed_post_id", "platform", "topic_key", "topic_label", "event_timestamp", "ingested_at",
        "author_id", "sentiment_label", "quality_score", "topic_confidence", "is_repost", "is_reply", "has_link",
    )


def merge_mentions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Idempotent upsert: newest flags, greatest times and confidence, never losing a known author or label."""
    key = ["raw_post_id", "platform", "topic_key"]
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    newest = lambda x: F.max_by(x, "__new").alias(x)
    filled = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col("__new"))).alias(x)
    return both.groupBy(*key).agg(
        filled("processed_post_id"), filled("topic_label"), F.max("event_timestamp").alias("event_timestamp"),
        F.max("ingested_at").alias("ingested_at"), filled("author_id"), newest("sentiment_label"),
        newest("quality_score"), F.max("topic_confidence").alias("topic_confidence"), newest("is_repost"),
        newest("is_reply"), newest("has_link"),
    )


def merge_rules():
    """The rules of ``merge_mentions`` for a stored, day-partitioned table; versions are ingestion times, not the order of arrival."""
    from tidegauge.sources.merging import MergeRules

    return MergeRules(
        key=("raw_post_id", "platform", "topic_key"), version="ingested_at", greatest=("event_timestamp", "topic_confidence"),
        latest=("sentiment_label", "quality_score", "is_repost", "is_reply", "has_link"), known=("processed_post_id", "topic_label", "author_id"))


def is_garbage(key: str = "topic_key", confidence: str = "topic_confidence") -> Column:
    """Stored mentions that later rules would no longer let in."""
    k = F.lower(F.coalesce(c(key), F.lit("")))
    toks = F.split(k, " ")
    listed = words(fixed.WEAK_WORDS + fixed.TOPIC_NOISE + fixed.NUMBER_WORDS + fixed.URL_DEBRIS)
    acr = words(fixed.ACRONYMS)
    informative = F.exists(toks, lambda t: (t != "") & ~one_of(t, listed) & ((F.length(t) >= 4) | one_of(t, acr)))
    return (
        (F.trim(k) == "") | k.isin(*fixed.BLOCKED_KEYS) | (F.coalesce(c(confidence), F.lit(0.0)) < 0.20)
        | k.rlike(fixed.BOT_PATTERN) | k.rlike(fixed.LINK_WORD_PATTERN) | k.rlike(fixed.WEATHER_PATTERN)
        | k.rlike(fixed.DETAIL_PATTERN) | ((F.size(toks) == 1) & one_of(k, listed))
        | (count_in(toks, fixed.NUMBER_WORDS) == F.size(toks)) | ~informative
    )


def minute_mentions(topics: DataFrame, processed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions for the plain minute rollup: topic rows plus, for posts without any topic row, their fallback topic."""

    def spell(x: str) -> Column:
        s = F.lower(F.coalesce(F.col(x), F.lit("")))
        return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9$#\s]+", " "), r"\s+", " "))

    merged = ("nokings", "no king", "no kings", "no kings s", "no kingss")  # spellings of one movement
    fold = lambda k: F.when(k.isin(*merged), "no kings").otherwise(k)
    facts = ["author_id", "quality_score", "is_repost", "is_reply", "has_link", "sentiment_label"]
    direct = barrier(with_processed(topics, processed).select(
        F.date_trunc("minute", "bucket_minute").alias("bucket_minute"), "platform",
        fold(spell("normalized_topic")).alias("normalized_topic"), "raw_post_id", *facts,
        F.coalesce(*[F.when(F.col("topic_type") == t, r) for t, r in fixed.TYPE_RANK.items()], F.lit(9)).alias("topic_priority"),
    )).where(topic_ok("normalized_topic"))
    direct = best(
        direct, ["raw_post_id", "platform", "normalized_topic"],
        [F.col("topic_priority").asc(), F.col("quality_score").desc()],
    )
    fallback = processed.join(topics.select("raw_post_id").distinct(), "raw_post_id", "left_anti").select(
        F.date_trunc("minute", "bucket_minute").alias("bucket_minute"), "platform",
        fold(spell("topic_key_candidate")).alias("normalized_topic"), "raw_post_id", "author_id", "quality_score",
        "is_repost", "is_reply", (F.size("urls") > 0).alias("has_link"), "sentiment_label", F.lit(9).alias("topic_priority"),
    ).where(F.coalesce("normalized_topic", F.lit("")) != "")
    all_rows = direct.unionByName(barrier(fallback))
    k, toks = F.col("normalized_topic"), F.split("normalized_topic", " ")
    weak_or_noise = fixed.WEAK_WORDS + [w for w in fixed.TOPIC_NOISE if w != "digit"]
    return all_rows.where(
        topic_ok("normalized_topic") & ~k.rlike(fixed.BOT_PATTERN) & ~k.rlike(fixed.WEATHER_PATTERN)
        & ~k.rlike(fixed.DETAIL_PATTERN)
        & (count_in(toks, weak_or_noise) <= F.greatest(F.lit(1), F.size(toks) - 1))
        & F.exists(toks, lambda t: ~one_of(t, weak_or_noise) & (F.length(t) >= 4))
    ).withColumn(
        "sentiment_label",
        F.when(F.col("sentiment_label").isin("positive", "negative", "neutral"), F.col("sentiment_label")).otherwise("neutral"),
    )


def topic_ok(key: str) -> Column:
    """Noise-token anti filter as array predicates instead of NOT EXISTS subqueries."""
    k = c(key)
    noise = [w for w in fixed.TOPIC_NOISE if w != "digit"]
    return (
        (k != "") & ~k.isin("all", "general") & ~one_of(k, fixed.WEAK_WORDS)
        & (F.length(F.replace(k, F.lit(" "), F.lit(""))) >= 2)
        & ~F.arrays_overlap(F.split(k, " "), F.array(*[F.lit(w) for w in noise]))
    )
