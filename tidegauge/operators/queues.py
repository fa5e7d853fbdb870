"""Work queues and boards of a run: interleaving, priorities, refresh targets, summaries, validity gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.basic import Col, age_hours, barrier, blank_to_null, c, clamp
from tidegauge.functions.scores import floor_ladder, ladder
from tidegauge.operators.windows import best, chunked_rank, top_n

# -- queues -------------------------------------------------------------------------------------


def pattern_interleave(rows: DataFrame, tier: str, order: list[Column], pattern: list[str]) -> DataFrame:
    """rows with (phase, cycle, slot): read in that order, tiers alternate as in the pattern.

    A tier that stands n times in the pattern gives n rows per cycle; what is used up is skipped.  Tiers outside the pattern come
    last, one row each per cycle.  The place inside a tier decides everything, so no queue is walked."""
    ranked = chunked_rank(rows, [tier], order, "__n")
    slots = {t: [i for i, p in enumerate(pattern) if p == t] for t in dict.fromkeys(pattern)}
    n = F.col("__n") - 1
    cycle, slot = None, None
    for name, places in slots.items():
        mine = F.col(tier) == name
        cycle = (F if cycle is None else cycle).when(mine, F.floor(n / len(places)))
        slot = (F if slot is None else slot).when(mine, F.get(F.array(*[F.lit(p) for p in places]), (n % len(places)).cast("int")).cast("long"))
    inside = F.coalesce(F.col(tier).isin(*slots), F.lit(False))
    return ranked.withColumns({"phase": F.when(inside, 0).otherwise(1), "cycle": cycle.otherwise(n), "slot": slot.otherwise(F.lit(0).cast("long"))}).drop("__n")


NAMED_SOURCES = ("ai_exact", "historical_exact", "historical_alias")


def pending_first(topics: DataFrame, names: DataFrame, key: str, latest: list[Column], limit: int) -> DataFrame:
    """Topics that still lack a trusted name first, then by mentions, posts and key.  names: key, canonical_name, name_status, name_source."""
    newest = best(names, [key], latest).select(
        F.col(key).alias("__k"), blank_to_null("canonical_name").alias("__name"), F.coalesce(blank_to_null("name_status"), F.lit("pending")).alias("__status"),
        F.coalesce(blank_to_null("name_source"), F.lit("none")).alias("__source"))
    joined = topics.join(newest, F.col(key) == F.col("__k"), "left")
    named = F.coalesce((F.col("__status") == "ready") & F.col("__source").isin(*NAMED_SOURCES) & F.col("__name").isNotNull(), F.lit(False))
    out = joined.withColumn("named", named).drop("__k", "__name", "__status", "__source")
    return out.orderBy(F.col("named").asc(), F.col("total_mentions").desc(), F.col("unique_posts").desc(), F.col(key).asc()).limit(limit)


def refresh_targets(posts: DataFrame, source: str, key: str, threshold: int, per_source: int) -> DataFrame:
    """Per source the posts to expand: those with enough comments first, then the next ones up to the limit; an id counts once."""
    order = [(F.col("comments") >= threshold).desc(), F.col("comments").desc(), F.col("score").desc(), F.col("created").desc(), F.col(key).asc()]
    return best(top_n(posts, [source], order, per_source), [key], [F.col("comments").desc(), F.col(source).asc()])


def backfill_order(assets: DataFrame, runs: DataFrame, results: DataFrame, n_runs: int, limit: int) -> DataFrame:
    """Assets of recent publishing runs first, newest publication first; among equals the one checked longest ago."""
    recent = runs.where((F.col("status") == "succeeded") & (F.col("published") > 0)).orderBy(F.col("completed_at").desc(), F.col("run_id").desc()).limit(n_runs)
    seen = results.join(recent.select("run_id", "completed_at"), "run_id").groupBy("asset_id").agg(F.max("completed_at").alias("last_published_at"))
    joined = assets.join(seen, "asset_id", "left")
    fallback = F.coalesce("updated_at", "created_at")
    return joined.orderBy(
        F.col("last_published_at").isNull().asc(), F.coalesce("last_published_at", fallback).desc(), F.coalesce("checked_at", fallback).asc(),
        F.col("updated_at").desc_nulls_last(), F.col("asset_id").desc()).limit(limit)


# -- boards and runs ------------------------------------------------------------------------------


def board_distribution(rows: DataFrame, keys: list[str], band: str) -> DataFrame:
    """Counts and shares of the three bands of a board, and why it would be rejected (null: it would not)."""
    n = F.col("n")
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(band) == "high").alias("high"), F.count_if(F.col(band) == "medium").alias("medium"))
    out = out.withColumn("low", n - F.col("high") - F.col("medium"))
    half_up = lambda x: F.floor(F.round(x, 9) + 0.5)
    big = n >= 100
    high_min = F.when(big, 30).otherwise(F.greatest(F.lit(1), half_up(n * 0.25)))
    high_max = F.when(big, 48).otherwise(F.greatest(high_min, half_up(n * 0.52)))
    medium_min = F.when(big, 32).otherwise(half_up(n * 0.25))
    low_max = F.when(big, 25).otherwise(F.ceil(n * 0.25))
    reason = F.when(F.col("high") < high_min, "high too low").when(F.col("high") > high_max, "high too high").when(
        F.col("medium") < medium_min, "medium too low").when(F.col("low") > low_max, "low too high")
    return out.withColumns({f"{b}_pct": half_up(F.col(b) / n * 100).cast("long") for b in ("high", "medium", "low")}).withColumn("rejected", reason)


def reconcile_fetch(fetched: DataFrame, stored: DataFrame, key: str, source: str) -> DataFrame:
    """Per source: rows fetched, new ones and those that were stored already."""
    known = stored.select(F.col(key).alias("__id")).where(F.col("__id").isNotNull()).distinct()
    rows = fetched.where(blank_to_null(F.col(key).cast("string")).isNotNull() & blank_to_null(source).isNotNull()).join(known, F.col(key) == F.col("__id"), "left")
    return rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("__id").isNull()).alias("new"), F.count_if(F.col("__id").isNotNull()).alias("refreshed"))


def run_summary(buckets: DataFrame, keys: list[str], status: str, counters: list[str]) -> DataFrame:
    """One row per run over its buckets; partly failed runs are partial."""
    count = lambda s: F.count_if(F.col(status) == s)
    out = buckets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("buckets"), count("success").alias("succeeded"), count("partial").alias("partly"), count("failed").alias("failed"),
        *[F.sum(F.coalesce(x, F.lit(0))).alias(x) for x in counters])
    return out.withColumn("run_status", F.when((F.col("failed") > 0) & (F.col("succeeded") + F.col("partly") > 0), "partial").when(
        F.col("failed") > 0, "failed").otherwise("success"))


def channel_overview(registry: DataFrame, state: DataFrame, messages: DataFrame, channel: str, at: str) -> DataFrame:
    """Every registered channel with its sync state and the number and newest time of its messages."""
    stats = messages.groupBy(channel).agg(F.count(F.lit(1)).alias("message_count"), F.max(at).alias("latest_at"))
    return registry.join(state, channel, "left").join(stats, channel, "left")


def mention_posts(mentions: DataFrame, processed: DataFrame, raw: DataFrame, per_topic: int, since: Column | None = None, until: Column | None = None,
                  platform: str = "bluesky") -> DataFrame:
    """Newest mentions of every topic with what the processed and the raw post know; the mention itself is the last resort.

    Bounds are applied to the mentions before the joins."""
    m = mentions
    if since is not None:
        m = m.where(F.col("event_timestamp") >= since)
    if until is not None:
        m = m.where(F.col("event_timestamp") < until)
    p = processed.select(*[F.col(x).alias(f"p_{x}") for x in ("id", "platform", "text", "quality_score", "author_id")])
    r = raw.select(*[F.col(x).alias(f"r_{x}") for x in ("id", "source_post_id", "platform", "text", "author_id", "likes")])
    rows = m.join(p, m["processed_post_id"] == p["p_id"], "left").join(r, m["raw_post_id"] == r["r_id"], "left")
    first = lambda *xs: F.coalesce(*[blank_to_null(F.col(x).cast("string")) for x in xs])
    rows = rows.select(
        "topic_key", "raw_post_id", "event_timestamp", F.coalesce(first("r_source_post_id"), F.col("raw_post_id").cast("string")).alias("source_post_id"),
        F.coalesce(first("r_platform", "p_platform", "platform"), F.lit(platform)).alias("platform"), first("p_text", "r_text").alias("text"),
        F.coalesce("p_quality_score", "quality_score", F.lit(0.0)).cast("double").alias("quality"), first("author_id", "r_author_id", "p_author_id").alias("author_id"),
        F.coalesce("r_likes", F.lit(0)).alias("likes"))
    return top_n(rows, ["topic_key"], [F.col("event_timestamp").desc(), F.col("quality").desc(), F.col("raw_post_id").desc()], per_topic, "place")


# -- scores and gates ------------------------------------------------------------------------------


def processing_priority(text: Col, entities: Col, phrases: Col, hashtags: Col, urls: Col, interactions: Col) -> Column:
    """Value of reading a root next: interactions, evidence, variety and length of its text."""
    t = F.trim(F.coalesce(c(text), F.lit("")))
    words = F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    e, p, h, u, i = (c(x) for x in (entities, phrases, hashtags, urls, interactions))
    return (
        F.least(F.lit(120.0), F.log2(F.greatest(F.lit(1), i) + 1) * 22) + floor_ladder(i, ((48, 60), (24, 40), (12, 24), (6, 12)), 0)
        + e * 10 + p * 12 + h * 8 + u * 6 + F.least(F.lit(24.0), F.log2(F.size(F.array_distinct(words)) + 1) * 5)
        + F.least(F.lit(18.0), F.log2(F.length(t) + 1) * 2.5) + F.when(e + p + h + u > 0, 10).otherwise(0))


def snapshot_freshness(age_minutes: Col) -> Column:
    return F.when(c(age_minutes).isNull(), "mixed").otherwise(ladder(age_minutes, ((90, "fresh"), (240, "mixed"), (720, "delayed")), "stale"))


def rank_lifecycle(rank: Col) -> Column:
    return ladder(rank, ((20, "Established"), (60, "Expanding")), "Emerging")


def activity_estimate(rank: Col, sources: Col, score: Col) -> Column:
    """Assumed number of posts behind a ranked item that came without counts."""
    n = F.greatest(F.lit(1), F.coalesce(c(sources), F.lit(1)))
    return F.greatest(n.cast("long"), F.floor((101 - c(rank)) * 18 + n * 12 + clamp(score, 0.0, 100.0) * 4 + 0.5).cast("long"))


def identity(x: Col) -> Column:
    """Letters and digits of a name without its sigils."""
    return F.regexp_replace(F.lower(F.coalesce(c(x), F.lit(""))), "[^a-z0-9]+", "")


def cluster_status(key: Col, label: Col, posts: Col, authors: Col, sampled_authors: Col, deduped: Col, coherence: Col, top_share: Col, short_ratio: Col,
                   min_authors: int = 5, min_posts: int = 8, min_coherence: float = 0.18, mixed_coherence: float = 0.10, max_share: float = 0.65) -> Column:
    """struct(status, reasons): junk labels first, then missing evidence, then coherence of clusters that are large enough."""
    k, name = identity(key), F.when(identity(label) != "", identity(label)).otherwise(identity(key))
    fragment = (k == "") | (identity(label) == "") | ((F.length(k) >= 3) & (F.length(identity(label)) == F.length(k) + 1)
                                                      & (F.substring(identity(label), F.lit(2), F.length(identity(label))) == k))
    junk = (F.length(name) < 3) & ~name.isin("ai", "uk", "us", "eu")
    why = lambda test, reason: F.when(test, F.lit(reason))
    missing = F.filter(F.array(
        why(c(authors) < min_authors, "insufficient_unique_authors"), why(c(posts) < min_posts, "insufficient_unique_posts"),
        why((c(sampled_authors) >= 3) & (c(top_share) > max_share), "author_concentration_too_high"), why(c(short_ratio) > 0.75, "short_post_ratio_too_high")),
        lambda x: x.isNotNull())
    out = lambda status, reasons: F.struct(F.lit(status).alias("status"), reasons.cast("array<string>").alias("reasons"))
    low = F.array(F.lit("coherence_too_low"))
    return F.when(fragment, out("junk", F.array(F.lit("suspicious_topic_key")))).when(junk, out("junk", F.array(F.lit("junk_label")))).when(
        F.size(missing) > 0, out("insufficient_evidence", missing)).when(
        (c(deduped) >= 4) & (c(coherence) < mixed_coherence), out("insufficient_evidence", low)).when(
        (c(deduped) >= 4) & (c(coherence) < min_coherence), out("mixed", low)).otherwise(out("ok", F.array()))


# Thresholds of stored market data.
MIN_LIQUIDITY, MIN_VOLUME, MIN_TRADES, TRUST_HOURS, LAST_GOOD_HOURS = 750.0, 400.0, 2, 4, 48


def live_validity(as_of: Column, chain: Col, token: Col, pair: Col, url: Col, status: Col, live: Col, validated_at: Col, updated_at: Col,
                  liquidity: Col, volume: Col, trades: Col) -> Column:
    """struct(trusted, fallback): may a stored validation be trusted, and may stored metrics stand in for a live look-up."""
    known = blank_to_null(chain).isNotNull() & blank_to_null(token).isNotNull() & (blank_to_null(pair).isNotNull() | blank_to_null(url).isNotNull())
    state = F.coalesce(F.lower(blank_to_null(status)), F.lit(""))
    within = lambda at, hours: c(at).isNotNull() & (age_hours(as_of, at) <= hours)
    said_live = (state == "live") | F.coalesce(c(live), F.lit(False))
    enough = (F.coalesce(c(liquidity), F.lit(0.0)) >= MIN_LIQUIDITY) & (
        (F.coalesce(c(volume), F.lit(0.0)) >= MIN_VOLUME) | (F.coalesce(c(trades), F.lit(0)) >= MIN_TRADES))
    usable = known & (state != "invalid")
    newest = F.coalesce(c(validated_at), c(updated_at))
    return F.struct((usable & within(validated_at, TRUST_HOURS) & said_live).alias("trusted"),
                    (usable & within(newest, LAST_GOOD_HOURS) & (said_live | enough)).alias("fallback"))


def selection_score(correlation: Col, tier: Col, market: Col, fit: Col, support_posts: Col, token_hits: Col, theme_hits: Col, fill: Col, soft_penalty: Col,
                    hit_penalty: float, theme_penalty: float, hit_cap: int) -> Column:
    """Correlation adjusted for tier, support and novelty, less what was shown lately."""
    bonus = F.when(c(tier) == "high", 5.0).when(c(tier) == "medium", 2.0).otherwise(0.0)
    repeated = c(token_hits) * hit_penalty + c(theme_hits) * theme_penalty + F.greatest(F.lit(0), c(token_hits) - hit_cap) * 0.2
    return (c(correlation) + bonus + F.least(F.lit(2.5), c(market) * 0.04) + F.least(F.lit(2.0), c(fit) * 0.08) + F.least(F.lit(3.5), c(support_posts) * 1.0)
            + F.when(c(token_hits) == 0, 1.75).otherwise(0.0) + F.greatest(F.lit(0.0), c(fill) * 0.05) - c(soft_penalty) * 0.7 - repeated)


def correlation_label(score: Col) -> Column:
    return floor_ladder(score, ((80, "High"), (60, "Medium"), (40, "Speculative")), "Coverage")


def _first_phrases(base: DataFrame, source: str, weight: str, per_text: int) -> DataFrame:
    def runs(size: int) -> Column:
        starts = F.when(F.size("w") >= size, F.sequence(F.lit(1), F.size("w") - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i, size)))

    found = F.array_distinct(F.concat(runs(3), runs(2)))
    said = base.select(source, weight, F.explode(F.slice(found, 1, per_text)).alias("phrase"))
    return said.groupBy("phrase").agg(F.count_distinct(source).alias("sources"), F.sum(weight).alias("weight"))


def _all_phrases(base: DataFrame, source: str, weight: str) -> DataFrame:
    """Every pair and triple of words; a row is a pair with the word behind it, so one shuffle by the pair serves both.

    ``first`` marks one row of each pair of a text, so that a pair counts once a text whatever follows it."""
    starts = F.when(F.size("w") >= 2, F.sequence(F.lit(1), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i, 3)))  # the last one is a pair alone
    # equal pairs stand beside each other in the order of the runs, as a space sorts before what words consist of
    sorted_runs = barrier(base.select(source, weight, F.sort_array(F.array_distinct(runs)).alias("x")))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("x", F.lit(1), F.greatest(F.size("x") - 1, F.lit(0))))
    each = sorted_runs.where(F.size("x") > 0).select(F.col(source).alias("s"), F.col(weight).alias("v"), F.inline(F.arrays_zip(F.col("x").alias("x"), before.alias("y"))))
    pair = lambda x: F.substring_index(x, " ", 2)
    cut = each.select("s", "v", pair("x").alias("p"), "x", (~pair("x").eqNullSafe(pair("y"))).alias("first"))
    said = cut.select("s", "v", "p", F.nullif(F.expr("substring(x, length(p) + 2)"), F.lit("")).alias("t"), "first").repartition("p")
    # behind the shuffle a row is its triple (the third word) and, if marked, its pair (no third word)
    ends = F.array_compact(F.array(F.col("t"), F.when(F.col("first"), F.lit(""))))
    counted = said.select("p", "s", "v", F.explode(ends).alias("t")).groupBy("p", "t", "s").agg(F.sum("v").alias("v")).groupBy("p", "t").agg(F.count("s").alias("sources"), F.sum("v").alias("weight"))
    return counted.select(F.concat_ws(" ", "p", F.nullif("t", F.lit(""))).alias("phrase"), "sources", "weight")


def breakout_phrases(rows: DataFrame, text: str, source: str, weight: str, stop_words: list[str], per_text: int | None = None, limit: int | None = None) -> DataFrame:
    """(phrase, sources, weight): word triples and pairs of the informative words of each text, each once a text; with ``per_text`` only its first ones, triples before pairs."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*stop_words) & ~w.rlike("^[0-9]+$"))
    base = rows.select(source, weight, words.alias("w"))
    out = _all_phrases(base, source, weight) if per_text is None else _first_phrases(base, source, weight, per_text)
    return out if limit is None else out.orderBy(F.col("sources").desc(), F.round("weight", 6).desc(), F.length("phrase").desc(), F.col("phrase").desc()).limit(limit)
