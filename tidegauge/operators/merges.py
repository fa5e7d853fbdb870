"""Merges of datasets: processed refresh, source catalog, channel diagnostics, cluster synthesis, interpretations, representative counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.basic import Col, blank_to_null, c
from tidegauge.operators.windows import best, top_n


def refresh_processed(raw: DataFrame) -> DataFrame:
    """Processed posts rebuilt from raw ones with neutral defaults; rows without platform, id or time drop out.

    raw: id, platform, source_post_id, post_id, author_id, created_at, ingested_at, raw_text, text_content, hashtags, urls, reply_parent_id, repost_of_uri."""
    none = F.array().cast("array<string>")
    text, key = F.coalesce("raw_text", "text_content"), F.coalesce("source_post_id", "post_id")
    rows = raw.where(F.col("platform").isNotNull() & key.isNotNull() & F.col("created_at").isNotNull())
    return rows.select(
        F.col("id").alias("raw_post_id"), "platform", key.alias("source_post_id"), "author_id", "created_at", F.coalesce("ingested_at", "created_at").alias("processed_at"),
        F.date_trunc("minute", "created_at").alias("bucket_minute"), text.alias("clean_text"), text.alias("normalized_text"), F.lit(0.0).alias("quality_score"),
        F.lit("general").alias("topic_key_candidate"), F.col("reply_parent_id").isNotNull().alias("is_reply"), F.col("repost_of_uri").isNotNull().alias("is_repost"),
        F.array(F.lit("general")).alias("tags"), F.coalesce("hashtags", none).alias("hashtags"), F.coalesce("urls", none).alias("urls"),
        F.lit("neutral").alias("sentiment_label"), F.lit("all").alias("topic"))


# What a discovered source must show.
MIN_SUBSCRIBERS, MIN_POSTS_PER_DAY, SPAM_SUBSCRIBERS, SPAM_POSTS_PER_DAY = 15_000, 5.0, 100_000, 12.0


def source_catalog(defined: DataFrame, discovered: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Defined sources, then discovered ones that pass the gates; the first of a name (in any case) stays.

    Both: name, category, priority; discovered also subscribers, posts_per_day, blocked (excluded, private, ...), spam_prone.  ``categories``: the enabled
    ones (None: every named one)."""
    few = (F.coalesce("subscribers", F.lit(0)) < MIN_SUBSCRIBERS) & (F.coalesce("posts_per_day", F.lit(0.0)) < MIN_POSTS_PER_DAY)
    spam = F.coalesce("spam_prone", F.lit(False)) & (F.coalesce("subscribers", F.lit(0)) < SPAM_SUBSCRIBERS) & (
        F.coalesce("posts_per_day", F.lit(0.0)) < SPAM_POSTS_PER_DAY)
    enabled = F.col("category").isNotNull() if categories is None else F.col("category").isin(*categories)
    good = discovered.where(enabled & ~F.coalesce("blocked", F.lit(False)) & ~few & ~spam)
    both = defined.select("name", "category", "priority", F.lit(0).alias("found")).unionByName(good.select("name", "category", "priority", F.lit(1).alias("found")))
    named = both.withColumn("name", blank_to_null("name")).where("name IS NOT NULL").withColumn("key", F.lower("name"))
    return best(named, ["key"], [F.col("found").asc(), F.col("category").asc(), F.col("priority").desc(), F.col("name").asc()])


def channel_diagnostics(configured: DataFrame, resolved: DataFrame, state: DataFrame, messages: DataFrame) -> DataFrame:
    """Every configured reference: resolved or not, number and newest time of stored messages, last state.

    configured: channel_ref; resolved: channel_ref, channel_id; state: channel_id, last_status; messages: channel_id, at."""
    stats = messages.groupBy("channel_id").agg(F.count(F.lit(1)).alias("messages"), F.max("at").alias("latest_at"))
    joined = configured.join(resolved, "channel_ref", "left").join(stats, "channel_id", "left").join(state, "channel_id", "left")
    known = F.col("channel_id").isNotNull()
    return joined.select(
        "channel_ref", F.coalesce("channel_id", F.lit(0)).alias("channel_id"), known.alias("resolved"),
        F.when(known, F.coalesce("messages", F.lit(0))).alias("messages"), "latest_at", F.when(known, F.col("last_status")).alias("last_status"))


def cluster_synthesis(members: DataFrame, cluster: str, label: str, weight: str, trusted: str, entities: str, keep: int = 6) -> DataFrame:
    """One enrichment per cluster: text of the largest member that has one, and the entities of all (in any case once, most named first).

    members also have ``name`` (null: not enriched), ``status`` and ``description``."""
    enriched = members.where(F.col("name").isNotNull())
    lead = best(enriched, [cluster], [F.col(weight).desc(), F.col(label).asc(), F.col("name").asc()]).select(cluster, "description", F.col("status").alias("lead_status"))
    sure = best(enriched.where(F.col(trusted)), [cluster], [F.col(weight).desc(), F.col(label).asc(), F.col("name").asc()]).select(cluster, F.col("name").alias("sure_name"))
    said = members.select(cluster, F.explode(F.concat(F.coalesce(entities, F.array().cast("array<string>")), F.array(label))).alias("e")).where(blank_to_null("e").isNotNull())
    counted = said.groupBy(cluster, F.lower("e").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("e"))
    named = top_n(counted, [cluster], [F.col("n").desc(), F.col("k").asc()], keep, "place").groupBy(cluster).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "e"))), lambda x: x["e"]).alias("key_entities"))  # at most ``keep``
    out = members.select(cluster).distinct().join(lead, cluster, "left").join(sure, cluster, "left").join(named, cluster, "left")
    return out.withColumn("status", F.when(F.col("sure_name").isNotNull(), "mixed").otherwise(F.coalesce("lead_status", F.lit("insufficient_evidence")))).drop("lead_status")


def semantic_candidates(roots: DataFrame, interpretations: DataFrame, root: str, author: str) -> DataFrame:
    """(root, key, kind, quality, priority): grouping keys that interpretations give to roots.

    The semantic key leads, up to three other keys follow, and template-like texts group under their author."""
    norm = lambda x: F.nullif(F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(""))
    joined = roots.join(interpretations, root).withColumn("__k", norm(F.coalesce("semantic_key", "label")))
    others = F.slice(F.filter(F.array_distinct(F.transform("secondary_keys", norm)), lambda x: x.isNotNull() & ~x.eqNullSafe(F.col("__k"))), 1, 3)
    template = norm(F.concat_ws(" ", F.col(author).cast("string"), F.coalesce(blank_to_null("semantic_key"), blank_to_null("label"))))
    is_template = F.col(author).isNotNull() & (F.coalesce("is_template", F.lit(False)) | (F.coalesce("template_likelihood", F.lit(0.0)) >= 0.72) | (
        F.coalesce("spam_likelihood", F.lit(0.0)) >= 0.72))
    item = lambda key, kind, quality, priority: F.struct(key.alias("key"), F.lit(kind).alias("kind"), quality.cast("double").alias("quality"), priority.cast("long").alias("priority"))
    q = F.col("quality")
    every = F.concat(
        F.array(F.when(F.col("__k").isNotNull(), item(F.concat(F.lit("ai:"), "__k"), "ai_semantic", q, F.lit(580)))),
        F.transform(others, lambda x, i: item(F.concat(F.lit("ai:"), x), "ai_semantic", F.greatest(F.lit(0.0), q - (i + 1) * 4), 520 - i * 12)),
        F.array(F.when(is_template & template.isNotNull(), item(F.concat(F.lit("template:"), template), "author_template", F.greatest(F.lit(0.0), F.least(F.lit(100.0), q - 8)), F.lit(560)))))
    return joined.select(root, F.inline(F.filter(every, lambda x: x.isNotNull())))


def representative_counts(engagement: Col, messages: Col, channels: Col) -> Column:
    """struct of assumed interactions of a representative message."""
    whole = lambda x, low: F.greatest(F.lit(low), F.floor(F.coalesce(c(x), F.lit(low)) + 0.5).cast("long"))
    e, m, ch = whole(engagement, 0), whole(messages, 1), whole(channels, 1)
    return F.struct(F.lit(1).cast("long").alias("posts"), F.greatest(F.lit(2), F.floor(e / 90 + 0.5).cast("long")).alias("reposts"),
                    F.greatest(F.lit(1), F.least(m, ch * 2)).alias("comments"), e.alias("likes"))


def apply_mapping(groups: DataFrame, mapping: DataFrame, key: str, sums: list[str], sets: list[str]) -> DataFrame:
    """Groups under the clusters of an external mapping (unmapped ones stay): counters add up, member arrays unite, the largest group names it.

    mapping: key, cluster."""
    placed = groups.join(mapping.withColumnRenamed(key, "__k"), F.col(key) == F.col("__k"), "left").withColumn("cluster", F.coalesce("cluster", F.col(key))).drop("__k")
    return placed.groupBy("cluster").agg(
        F.max_by(key, F.struct(F.col(sums[0]), F.col(key))).alias("lead"), F.count(F.lit(1)).alias("groups"), *[F.sum(x).alias(x) for x in sums],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x) for x in sets])


# Phrases and signals of a naming run that failed, and word ends of cut-off labels.
FAILED_SIGNAL = "visible_runtime_openai_failure"
FALLBACK_PHRASES = ("safe fallback because ai enrichment was unavailable", "using the cleaned fallback label")
FAILED_PHRASE = "visible runtime ai naming failed"
FRAGMENT_END = "(?:apital|eneral|etting|hased|arket|tion|ment|ally|ized)$"
TRUSTED_NAME_SOURCES = ("ai_exact", "historical_exact", "historical_alias")


def _has(text: Col, *phrases: str) -> Column:
    low = F.lower(F.coalesce(c(text), F.lit("")))
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(low, F.lit(phrase))
    return out


def name_state(raw: Col, canonical: Col, fallback: Col, status: Col, source: Col, summary: Col, abstain: Col, signals: Col, used_fallback: Col,
               authoritative: Col, shaped: Col) -> Column:
    """struct(canonical, fallback, name_status, name_source) of an enrichment.

    A name that differs from the raw label, came without a failed run and has the shape of a name (``shaped``) is ready; junk and thin
    evidence fail; anything else waits."""
    label, other = blank_to_null(raw), F.coalesce(blank_to_null(fallback), blank_to_null(raw))
    name = F.when(~F.lower(blank_to_null(canonical)).eqNullSafe(F.lower(label)), blank_to_null(canonical))
    broken = F.coalesce(F.array_contains(F.transform(signals, lambda s: F.lower(F.trim(s))), FAILED_SIGNAL), F.lit(False)) | _has(
        summary, *FALLBACK_PHRASES, FAILED_PHRASE) | _has(abstain, *FALLBACK_PHRASES, FAILED_PHRASE)
    ready = name.isNotNull() & c(status).isin("ok", "mixed") & ~F.coalesce(c(used_fallback), F.lit(False)) & ~broken & c(shaped)
    ready = F.coalesce(ready, F.lit(False))
    given = F.lower(F.coalesce(blank_to_null(source), F.lit("")))
    plain = F.when(other.isNotNull(), "fallback_cleaned").otherwise("none")
    failed = F.coalesce(c(status).isin("insufficient_evidence", "junk"), F.lit(False)) & ~broken
    return F.struct(
        F.when(ready, name).alias("canonical"), other.alias("fallback"), F.when(ready, "ready").when(failed, "failed").otherwise("pending").alias("name_status"),
        F.when(ready & given.isin(*TRUSTED_NAME_SOURCES), given).when(ready & c(authoritative), "ai_exact").when(ready, "historical_alias").otherwise(plain).alias("name_source"))


def quarantine_names(rows: DataFrame) -> DataFrame:
    """Enrichments with polluted names taken back; ``reason`` says why (null: row unchanged).

    rows: raw_label, canonical_name, fallback_label, status, name_status, name_source, narrative_summary, abstain_reason, mixed_signals, evidence."""
    good = F.coalesce(F.trim("status").isin("ok", "mixed"), F.lit(False))
    reason = F.when(_has("narrative_summary", *FALLBACK_PHRASES), "fallback_narrative").when(
        _has("abstain_reason", FAILED_PHRASE) | F.coalesce(F.exists("mixed_signals", lambda s: F.lower(s) == FAILED_SIGNAL), F.lit(False)), "runtime_failure").when(
        good & (F.lower(blank_to_null("canonical_name")) == F.lower(blank_to_null("raw_label"))), "canonical_equals_raw").when(
        good & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0), "missing_evidence").when(
        good & F.regexp_replace(F.lower(F.coalesce("raw_label", F.lit(""))), "[^a-z0-9]+", "").rlike(FRAGMENT_END), "fragment_like_raw_label")
    out = rows.withColumn("reason", reason)
    hit, label = F.col("reason").isNotNull(), blank_to_null("raw_label")
    return out.withColumns({
        "fallback_label": F.when(hit, F.coalesce(blank_to_null("fallback_label"), label)).otherwise(F.col("fallback_label")),
        "canonical_name": F.when(~hit, F.col("canonical_name")),
        "name_status": F.when(hit & (F.col("reason") == "runtime_failure"), "pending").when(hit, "failed").otherwise(F.col("name_status")),
        "name_source": F.when(hit & label.isNotNull(), "fallback_cleaned").when(hit, "none").otherwise(F.col("name_source"))})
