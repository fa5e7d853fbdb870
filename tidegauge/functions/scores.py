"""Score columns: interaction weights, freshness ladders, confidence, strength, breakout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegauge.functions.basic import Col, c, clamp, round1


def ladder(x: Col, steps, otherwise) -> Column:
    """First value whose upper bound is not exceeded."""
    out = None
    for bound, value in steps:
        out = (F if out is None else out).when(c(x) <= bound, value)
    return out.otherwise(otherwise)


def floor_ladder(x: Col, steps, otherwise) -> Column:
    """First value whose lower bound is reached."""
    out = None
    for bound, value in steps:
        out = (F if out is None else out).when(c(x) >= bound, value)
    return out.otherwise(otherwise)


def capped_log10(x: Col, factor: float, cap: float) -> Column:
    return F.least(F.lit(cap), F.log10(F.greatest(c(x), F.lit(0.0)) + 1) * factor)


def capped_log2(x: Col, factor: float, cap: float) -> Column:
    return F.least(F.lit(cap), F.log2(F.greatest(c(x), F.lit(0.0)) + 1) * factor)


# --- fixed values: interaction weights and caps --------------------------------------
POST_W, REPOST_W, COMMENT_W, LIKE_W = 14, 7, 3, 1
REPOST_CAP, COMMENT_CAP, LIKE_CAP = 18, 12, 6


def _parts(posts: Col, reposts: Col, comments: Col, likes: Col) -> tuple[Column, ...]:
    pos = lambda x: F.greatest(F.lit(0), c(x))
    return (
        round1(pos(posts) * POST_W), round1(capped_log2(pos(reposts), REPOST_W, REPOST_CAP)),
        round1(capped_log2(pos(comments), COMMENT_W, COMMENT_CAP)), round1(capped_log10(pos(likes), LIKE_W, LIKE_CAP)),
    )


def weighted_interactions(posts: Col, reposts: Col, comments: Col, likes: Col) -> Column:
    p, r, m, l = _parts(posts, reposts, comments, likes)
    return round1(p + r + m + l)


def narrative_interactions(posts: Col, reposts: Col) -> Column:
    p, r, _, _ = _parts(posts, reposts, F.lit(0), F.lit(0))
    return round1(p + r)


def video_score(likes: Col, comments: Col, views: Col) -> Column:
    return round1(6 + capped_log10(likes, 4.5, 20) + capped_log10(comments, 6, 22) + capped_log10(views, 1.5, 9))


def _per_hour(delta: Col, minutes: Col) -> Column:
    hours = F.greatest(F.coalesce(c(minutes), F.lit(0.0)) / 60, F.lit(0.25))
    return F.greatest(F.coalesce(c(delta), F.lit(0)) / hours, F.lit(0.0))


def video_delta_score(views: Col, likes: Col, comments: Col, minutes: Col) -> Column:
    return round1(
        capped_log10(_per_hour(views, minutes), 4, 18) + capped_log10(_per_hour(likes, minutes), 5.5, 20)
        + capped_log10(_per_hour(comments, minutes), 8, 24)
    )


def comment_score(likes: Col, replies: Col) -> Column:
    return round1(weighted_interactions(F.lit(0), F.lit(0), F.lit(1), likes) + capped_log2(replies, 2.4, 8))


def post_score(posts: Col, reposts: Col, comments: Col, likes: Col, followers: Col, kind: Col) -> Column:
    extra = F.when(c(kind) == "quote", 4.2).when(c(kind) == "reply", 2.4).otherwise(0.0)
    return round1(weighted_interactions(posts, reposts, comments, likes) + capped_log10(followers, 2.1, 10) + extra)


def snapshot_score(reposts: Col, quotes: Col, replies: Col, likes: Col, minutes: Col) -> Column:
    return round1(
        capped_log10(_per_hour(c(reposts) + c(quotes), minutes), 11, 24) + capped_log10(_per_hour(replies, minutes), 9, 18)
        + capped_log10(_per_hour(likes, minutes), 5, 12)
    )


def interaction_event_score(kind: Col, followers: Col, observed: Col) -> Column:
    k = c(kind)
    counts = weighted_interactions(
        F.lit(0), F.when(k == "repost", 1).otherwise(0), F.when(k.isin("reply", "quote"), 1).otherwise(0),
        F.when(k == "like", 1).otherwise(0),
    )
    return round1(counts + capped_log10(followers, 1.8, 7) + F.when(k == "quote", 2.5).otherwise(0.0) + capped_log10(observed, 2.5, 8))


def discovery_weight(interactions: Col, score: Col, kind: Col, generic: Column, conversational: Column, question: Column,
                     named: Column, live: Column, post_type: Col, followers: Col, nested: Column) -> Column:
    k, t = c(kind), c(post_type)
    w = 1 + F.least(F.lit(8.0), c(interactions) / 20) + F.least(F.lit(4.0), F.greatest(c(score), F.lit(0)) / 60)
    w = w * F.when(k == "comment", 0.6).otherwise(1.0) * F.when(k == "delta", 0.35).otherwise(1.0)
    w = w * F.when(generic & ~named, 0.18).otherwise(1.0) * F.when(conversational, 0.42).otherwise(1.0)
    w = w * F.when(question & ~named, 0.58).otherwise(1.0)
    live_w = (
        w * F.when((k == "quote") | (t == "quote"), 1.18).otherwise(1.0) * F.when((k == "reply") | (t == "reply"), 0.96).otherwise(1.0)
        * F.when(k == "amplification", 0.52).otherwise(1.0) * F.when(nested, 0.92).otherwise(1.0) + capped_log10(followers, 0.7, 2.5)
    )
    return round1(F.when(live, live_w).otherwise(w))


def post_priority(reposts: Col, quotes: Col, replies: Col, likes: Col) -> Column:
    return F.round(
        5 + F.least(F.lit(16.0), (c(reposts) + c(quotes)) * 1.8) + F.least(F.lit(14.0), c(replies) * 1.4)
        + F.least(F.lit(10.0), c(likes) * 0.18), 1
    )


def refresh_priority(base: Col, interactions: Col, snapshots: Col, age_minutes: Col) -> Column:
    return (
        c(base) + F.log10(c(interactions) + 1) * 7 + F.log10(c(snapshots) + 1) * 4
        + F.greatest(F.lit(0.0), 48.0 - F.greatest(F.lit(1.0), c(age_minutes)) / 60)
    )


def engagement(likes: Col, reposts: Col, replies: Col, quotes: Col) -> Column:
    return c(likes) + c(reposts) * 2 + c(replies) * 2 + c(quotes) * 2


# --- fixed values: freshness ladders (minutes -> score) ------------------------------------
PLATFORM_FRESHNESS = {
    "bluesky": (((20, 100), (60, 86), (180, 66), (720, 40)), 16),
    "youtube": (((120, 100), (360, 84), (1440, 58), (2880, 34)), 16),
    "telegram": (((60, 100), (240, 82), (720, 58), (1440, 34)), 14),
    "google": (((60, 100), (240, 82), (720, 58), (1440, 34)), 14),
    "news": (((60, 100), (240, 82), (720, 58), (1440, 34)), 14),
}
OTHER_FRESHNESS = (((60, 100), (360, 80), (1440, 56), (2880, 34)), 14)


def platform_freshness(platform: Col, age_minutes: Col) -> Column:
    out = F.when(c(age_minutes).isNull(), 30)
    for name, (steps, rest) in PLATFORM_FRESHNESS.items():
        out = out.when(c(platform) == name, ladder(age_minutes, steps, rest))
    return out.otherwise(ladder(age_minutes, *OTHER_FRESHNESS)).cast("double")


def freshness_state(score: Col) -> Column:
    return floor_ladder(score, ((78, "fresh"), (58, "delayed"), (38, "mixed")), "stale")


def age_state(age_minutes: Col) -> Column:
    return ladder(age_minutes, ((12, "fresh"), (30, "mixed"), (90, "delayed")), "stale")


def growth_stage(growth: Col, state: Col) -> Column:
    g = c(growth)
    return (
        F.when((c(state) == "stale") & (g < -20), "Declining").when(g >= 60, "Emerging").when(g >= 20, "Expanding")
        .when(g <= -35, "Fading").otherwise("Established")
    )


def source_status(age_minutes: Col, failures: Col) -> Column:
    """struct(status, score): health of a source from its age and consecutive failures."""
    a, f = c(age_minutes), c(failures)
    pick = lambda none, healthy, delayed, degraded, stale: (
        F.when(a.isNull(), none).when((a <= 60) & (f == 0), healthy).when((a <= 360) & (f <= 1), delayed)
        .when(a <= 1440, degraded).otherwise(stale)
    )
    score = pick(0, 100, 82, 58, 24) - F.least(f, F.lit(4)) * 8
    return F.struct(
        pick("unknown", "healthy", "delayed", "degraded", "stale").alias("status"),
        F.greatest(F.lit(0), score).cast("long").alias("score"),
    )


def rank_factor(freshness: Col, aggressive: bool = False) -> Column:
    low, spread = (0.42, 0.58) if aggressive else (0.55, 0.45)
    return round1(clamp(low + clamp(freshness, 0.0, 100.0) / 100 * spread, low, 1.0))


def confidence(comments: Col, threads: Col, sources: Col, current: Col, authors: Col, roots: Col, concentration: Col) -> Column:
    part = lambda x, full, w: F.least(x / F.lit(float(full)), F.lit(1.0)) * w
    return round1(
        part(c(comments), 250, 44) + part(c(threads), 8, 18) + part(F.greatest(c(sources), c(authors)), 6, 18)
        + part(c(roots), 5, 12) + part(c(current), 40, 10) - F.least(F.lit(12.0), F.greatest(F.lit(0.0), c(concentration)) * 18)
    )


def adjusted_confidence(raw: Col, freshness: Col, state: Col) -> Column:
    s = c(state)
    stable = F.when(s == "fresh", 1.0).when(s == "delayed", 0.96).when(s == "mixed", 0.9).otherwise(0.78)
    return round1(c(raw) * rank_factor(freshness) * stable)


def strength(attention: Col, confidence_: Col, growth: Col, acceleration: Col, spread: Col, persistence: Col, live_share: Col) -> Column:
    score = (
        c(attention) * 0.3 + c(confidence_) * 0.18 + clamp(50 + c(growth) * 2.4, 0.0, 100.0) * 0.18
        + clamp(50 + c(acceleration) * 7.5, 0.0, 100.0) * 0.14 + clamp(c(spread) / F.lit(6.0) * 100, 0.0, 100.0) * 0.08
        + c(persistence) * 0.12 + clamp((c(live_share) - 35) * 0.18, 0.0, 8.0)
    )
    return round1(clamp(score, 0.0, 100.0))


def is_early(attention: Col, growth: Col, acceleration: Col, spread: Col, persistence: Col, stage: Col, live_share: Col) -> Column:
    need = F.when(c(live_share) >= 45, 1).otherwise(2)
    return (
        c(attention).between(14, 62) & (c(growth) >= -4) & (c(acceleration) >= 1.8) & (c(spread) >= need) & (c(spread) <= 4)
        & c(persistence).between(14, 92) & c(stage).isin("Emerging", "Expanding")
    )


def breakout(velocity: Col, novelty: Col, confirmation: Col, freshness: Col, confidence_: Col, growth: Col, acceleration: Col,
             mainstream: Col, spam: Col, spike_bonus: Col) -> Column:
    pct = lambda x: clamp(x, 0.0, 100.0)
    return round1(pct(
        pct(velocity) * 0.3 + pct(novelty) * 0.24 + pct(confirmation) * 0.16 + pct(freshness) * 0.1 + pct(confidence_) * 0.08
        + pct(50 + c(growth) * 2.4) * 0.07 + pct(50 + c(acceleration) * 7.5) * 0.05 + c(spike_bonus) - c(mainstream) - c(spam)
    ))


def momentum(x: Col, scale: float) -> Column:
    return round1(clamp(50 + c(x) * scale, 0.0, 100.0))


def lift(current: Col, previous: Col) -> Column:
    a, b = F.greatest(c(current), F.lit(0.0)), F.greatest(c(previous), F.lit(0.0))
    return round1(clamp((F.log2((a + 2) / (b + 2)) + 0.2) * 32 + capped_log10(a, 10, 14), 0.0, 100.0))


def stage_score(stage: Col) -> Column:
    s = c(stage)
    return (
        F.when(s == "Emerging", 100).when(s == "Expanding", 92).when(s == "Established", 36).when(s == "Fading", 22)
        .when(s == "Declining", 8).otherwise(28)
    )


def spread_score(platforms: Col, threads: Col, authors: Col) -> Column:
    return round1(clamp(
        16 + F.least(F.lit(44), c(platforms) * 15) + F.least(F.lit(36), c(threads) * 7) + capped_log2(authors, 4, 16), 0.0, 100.0
    ))
