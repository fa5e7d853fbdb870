"""Ranking models and leaderboards over one row per topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions import scores as sc
from tidegauge.functions.basic import c, clamp, round1
from tidegauge.operators.windows import chunked_rank, global_rank, top_n
from tidegauge.session import materialise


def established(rows: DataFrame) -> DataFrame:
    """Attention score (blend of components scaled to their maximum), strength and early flag.

    The six maxima come from one small aggregate joined as scalars, not from a window over all rows."""
    live = F.col("live_velocity")
    dominance = F.col("live_share") * F.log2(F.col("authors") + 1)
    df = rows.withColumn("__live", live).withColumn("__dom", dominance)
    parts = {"total": "total", "current": "current", "narrative": "narrative", "current_narrative": "current_narrative",
             "__live": "live", "__dom": "dom"}
    top = df.agg(*[F.max(x).alias(x) for x in parts]).select(F.struct("*").alias("t")).scalar()
    df = df.withColumn("__top", top)
    norm = lambda x: F.when((F.col(x) > 0) & (F.col("__top")[x] > 0), round1(F.col(x) / F.greatest(F.col("__top")[x], F.lit(1.0)) * 100)).otherwise(0.0)
    mixed = round1(
        norm("total") * 0.54 + norm("current") * 0.2 + norm("narrative") * 0.12 + norm("current_narrative") * 0.04
        + norm("__live") * 0.05 + norm("__dom") * 0.05
    )
    plain = round1(norm("narrative") * 0.7 + norm("current_narrative") * 0.3)
    base = F.when(F.col("__top")["total"] > 0, mixed).otherwise(plain)
    df = df.withColumn("attention_score", round1(clamp(base * sc.rank_factor("freshness"), 0.0, 100.0)))
    df = df.withColumn("strength", sc.strength(
        "attention_score", "confidence", "growth_rate", "acceleration", "spread", "persistence", "live_share"))
    return df.withColumn("is_early", sc.is_early(
        "attention_score", "growth_rate", "acceleration", "spread", "persistence", "stage", "live_share"
    )).drop("__live", "__dom", "__top")


def rank_change(rows: DataFrame, key: str, now: str, before: str) -> DataFrame:
    """Places gained between the earlier and the current window; keys break ties, so equal values are split over ranges too."""
    a = global_rank(rows, [F.col(now).desc(), F.col(key).asc()], "rank_now")
    b = global_rank(a, [F.col(before).desc(), F.col(key).asc()], "rank_before")
    return b.withColumn("position_change", F.col("rank_before") - F.col("rank_now"))


def mainstream_penalty(attention: str, rank: str, stage: str) -> Column:
    size = F.when(c(attention) > 58, F.least(F.lit(30.0), (c(attention) - 58) * 0.85)).otherwise(0.0)
    place = sc.ladder(rank, ((3, 18), (6, 10), (10, 4)), 0)
    life = F.when(c(stage) == "Established", 8).when(c(stage) == "Fading", 12).when(c(stage) == "Declining", 18).otherwise(0)
    return round1(size + place + life)


def emerging_from_established(rows: DataFrame) -> DataFrame:
    """Emerging score of established rows: abnormal lift, spread, lifecycle, confidence, small-narrative bonus."""
    abnormal = round1(
        sc.momentum("growth_rate", 1.7) * 0.22 + sc.momentum("acceleration", 8) * 0.28 + sc.lift("current", "prior") * 0.28
        + sc.lift("current_narrative", "prior_narrative") * 0.22
    )
    conf = F.col("confidence")
    steady = round1(clamp(
        conf + F.when(F.col("low_data") & (conf >= 34), 6).otherwise(0) - F.when(conf < 28, 12).when(conf < 36, 5).otherwise(0), 0.0, 100.0))
    small = F.when(F.col("attention_score") <= 52, F.least(F.lit(18.0), (52 - F.col("attention_score")) * 0.45)).otherwise(0.0)
    score = (
        abnormal * 0.42 + sc.spread_score("spread", "threads", "authors") * 0.18 + sc.stage_score("stage") * 0.15 + steady * 0.15
        + small + F.when(F.col("has_spike"), 4).otherwise(0) - mainstream_penalty("attention_score", "attention_rank", "stage")
    )
    return rows.withColumn("emerging_score", round1(clamp(score, 0.0, 100.0)))


def emerging_board(rows: DataFrame) -> DataFrame:
    """Velocity, novelty, confirmation and breakout of young groups, with mainstream and repetition penalties."""
    intensity = clamp(F.least(F.lit(56.0), F.col("total") / F.greatest(F.col("documents"), F.lit(1)) * 3)
                      + sc.capped_log10("current", 16, 24), 0.0, 100.0)
    inter, narr = sc.lift("current", "prior"), sc.lift("current_narrative", "prior_narrative")
    velocity = round1(clamp(
        sc.momentum("growth_rate", 1.9) * 0.26 + sc.momentum("acceleration", 8.4) * 0.28 + inter * 0.24 + narr * 0.14
        + intensity * 0.12 + F.when(F.col("has_spike"), 6).otherwise(0), 0.0, 100.0))
    recency = sc.ladder("first_seen_minutes", ((60, 100), (360, 88), (720, 72), (1440, 54), (2880, 34)), 16)
    low_base = F.when(F.col("prior") <= F.col("current"), F.greatest(F.lit(0.0), 30 - F.least(F.lit(30.0), F.col("prior") * 2.2))).otherwise(0.0)
    risk = F.col("concentration")
    niche = sc.ladder(risk, ((0.55, 14), (0.72, 8)), 0)
    repeated = F.when(risk > 0.88, 18).when(risk > 0.76, 10).otherwise(0)
    known = F.col("is_established")
    novelty = round1(clamp(recency * 0.56 + inter * 0.18 + low_base + niche - repeated - F.when(known, 12).otherwise(0), 0.0, 100.0))
    stage, state = F.col("stage"), F.col("freshness_state")
    confirmation = round1(clamp(
        14 + F.least(F.lit(30), F.col("confirmed_spread") * 16) + F.least(F.lit(24), F.col("sources") * 6) + sc.capped_log2("authors", 7, 20)
        + F.least(F.lit(14), F.col("roots") * 4) - F.when(state == "mixed", 6).when(state == "stale", 16).otherwise(0), 0.0, 100.0))
    mainstream = (
        F.when(known, 24).otherwise(0) + F.when(stage == "Established", 10).when(stage == "Fading", 14).when(stage == "Declining", 18).otherwise(0)
        + F.when(F.col("total") >= 160, 10).when(F.col("total") >= 90, 4).otherwise(0)
    )
    spam = F.when(F.col("label_quality") < 42, 10).when(F.col("label_quality") < 50, 4).otherwise(0) + repeated
    df = rows.withColumn("velocity", velocity).withColumn("novelty", novelty).withColumn("confirmation", confirmation)
    df = df.withColumn("breakout", sc.breakout(
        "velocity", "novelty", "confirmation", "freshness", "confidence", "growth_rate", "acceleration", mainstream, spam,
        F.when(F.col("has_spike"), 4).otherwise(0)))
    attention = round1(clamp((
        F.least(F.lit(100.0), F.log10(F.col("total") + 1) * 28) * 0.62 + F.least(F.lit(100.0), F.log10(F.col("current") + 1) * 34) * 0.38
    ) * sc.rank_factor("freshness", True), 0.0, 100.0))
    return df.withColumn("attention_score", attention).where((F.col("breakout") >= 30) | (F.col("current") >= 10))


def stable_scores(rows: DataFrame) -> DataFrame:
    """Scores of the read-model path from totals, trusted growth and velocity, age and sentiment."""
    m, p = F.col("total_mentions"), F.col("posts")
    fresh = clamp(100 - F.col("age_minutes") * 1.6, 0.0, 100.0)
    volume = clamp(F.log2(F.greatest(F.lit(1), m) + 1) * 12 + F.log2(F.greatest(F.lit(1), p) + 1) * 16, 0.0, 100.0)
    df = rows.withColumn("freshness", fresh).withColumn("volume", volume)
    g, v = F.greatest(F.lit(0.0), F.col("growth_rate")), F.col("velocity")
    mood = F.col("positive") + F.col("neutral") + F.col("negative")
    balance = F.when(mood > 0, (F.col("positive") - F.col("negative")) / mood).otherwise(0.0)
    df = df.withColumn("sentiment_balance", balance)
    return (
        df.withColumn("confidence", clamp(F.col("volume") * 0.85 + F.col("freshness") * 0.15, 0.0, 100.0))
        .withColumn("novelty", clamp(g * 0.55 + F.least(F.lit(24.0), v * 0.35), 0.0, 100.0))
        .withColumn("confirmation", clamp(F.col("volume") * 0.72 + F.col("freshness") * 0.08 + F.least(F.lit(20.0), p * 0.45), 0.0, 100.0))
        .withColumn("breakout", clamp(v * 0.34 + g * 0.28 + F.col("volume") * 0.28 + F.col("freshness") * 0.10
                                      + F.greatest(F.lit(0.0), F.col("sentiment_balance")) * 4, 0.0, 100.0))
        .withColumn("strength", clamp(F.col("volume") * 0.68 + g * 0.10 + F.col("freshness") * 0.12 + F.least(F.lit(10.0), v * 0.10), 0.0, 100.0))
        .withColumn("attention_score", clamp(m + p * 0.35 + g * 0.4 + F.col("freshness") * 0.08, 0.0, 1000.0))
        .withColumn("state", sc.age_state("age_minutes"))
        .withColumn("stage", sc.growth_stage("growth_rate", sc.age_state("age_minutes")))
    )


# --- fixed values: leaderboard orders (all end in the topic key) ----------------------------
SUPPORT = ["total_mentions", "posts", "strength", "confirmation", "unique_authors"]
ORDERS = {
    "posts": ["posts", "strength", "velocity"],
    "growth": ["growth_rate", "acceleration", "freshness", *SUPPORT],
    "mentions": ["total_mentions", "attention_score", *SUPPORT],
    "strength": ["strength", "attention_score", *SUPPORT],
    "attention": ["attention_score", "strength", *SUPPORT],
    "velocity": ["velocity", "breakout", "freshness", *SUPPORT],
    "novelty": ["novelty", "growth_rate", "breakout", *SUPPORT],
    "confirmation": ["confirmation", "breakout", "velocity", *SUPPORT],
    "breakout": ["breakout", "velocity", "novelty", "confirmation", *SUPPORT],
}
TIERS = ("primary_grouped", "secondary_singleton", "audit_fallback", "audit_template", "audit_low_information")


def leaderboard(rows: DataFrame, mode: str, key: str, limit: int = 250, digits: int = 9) -> DataFrame:
    """Top rows of a sort mode; ordering by rounded values, so equal scores tie on purpose (take-ordered, no full sort)."""
    order = [F.round(F.col(x).cast("double"), digits).desc_nulls_last() for x in ORDERS[mode]]
    return rows.orderBy(*order, F.col(key).asc()).limit(limit)


def tier(root_count: str, authors: str, author_share: str, interactions: str, quality: str, spam: str, low_info: Column,
         template: Column, fallback: Column, url_anchor: Column) -> Column:
    weak = (
        (c(root_count) == 2) & (c(authors) <= 2) & (c(author_share) >= 0.5) & ((c(interactions) < 6) | (c(quality) < 6))
    )
    return (
        F.when(low_info, "audit_low_information").when(template | (c(spam) >= 0.72), "audit_template").when(fallback, "audit_fallback")
        .when(weak, "audit_low_information")
        .when(c(root_count) <= 1, F.when(url_anchor, "audit_low_information").otherwise("secondary_singleton"))
        .otherwise("primary_grouped")
    )


def tier_first(rows: DataFrame, key: str, limit: int = 250) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    return rows.orderBy(rank, F.round("quality", 9).desc(), F.col(key).asc()).limit(limit)


def pin(rows: DataFrame, key: str, order: list[Column], selected, n: int) -> DataFrame:
    """Top n with the selected row forced in as the last one when it is not among them."""
    top = rows.orderBy(*order).limit(n).withColumn("pinned", F.lit(False))
    ranked = top_n(top.withColumn("__one", F.lit(1)), ["__one"], order, n, "place").drop("__one")
    has = ranked.agg(F.max((F.col(key) == selected).cast("int"))).scalar()
    keep = ranked.withColumn("__has", has).where((F.col("__has") == 1) | (F.col("place") < n)).drop("__has")
    extra = rows.where(F.col(key) == selected).withColumn("pinned", F.lit(True)).withColumn("place", F.lit(n)).withColumn("__has", has)
    return keep.unionByName(extra.where(F.col("__has") == 0).drop("__has"))


def related(rows: DataFrame, cluster: str, key: str, score: str, n: int = 4) -> DataFrame:
    """For every row its n strongest cluster mates: only the n+1 strongest of a cluster can be anyone's mates."""
    best = top_n(rows.select(F.col(cluster), F.col(key).alias("mate"), F.col(score).alias("mate_score")), [cluster],
                 [F.col("mate_score").desc(), F.col("mate").asc()], n + 1)
    pairs = rows.select(key, cluster).join(best, cluster).where(F.col(key) != F.col("mate"))
    return top_n(pairs, [key], [F.col("mate_score").desc(), F.col("mate").asc()], n, "place")


def series_seeds(rows: DataFrame, key: str, limit: int, min_mentions: int = 8, min_posts: int = 4, min_authors: int = 3) -> DataFrame:
    """70 % of the places by volume, the rest by freshness among well-supported rows."""
    import math

    volume = [F.col("total_mentions").desc(), F.col("unique_posts").desc(), F.col("unique_authors").desc(), F.col(key).asc()]
    slots = max(1, math.ceil(limit * 0.7))
    first = rows.orderBy(*volume).limit(slots).withColumn("seed", F.lit("volume"))
    support = (F.col("total_mentions") >= min_mentions).cast("int") + (F.col("unique_posts") >= min_posts).cast("int") + (
        F.col("unique_authors") >= min_authors).cast("int")
    fresh = [F.col("last_seen_at").desc(), F.col("unique_posts").desc(), F.col("total_mentions").desc(), F.col(key).asc()]
    rest = rows.join(first.select(key), key, "left_anti").where((support >= 2) & (F.col("total_mentions") >= max(2, min_mentions // 2)))
    return first.unionByName(rest.orderBy(*fresh).limit(limit - slots).withColumn("seed", F.lit("fresh")))


# --- ordered queues ----------------------------------------------------------------------------


def round_robin(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Place inside the own group; reading by (place, group) interleaves the groups."""
    return chunked_rank(df, [group], order, "turn")


def repeat_by_weight(df: DataFrame, weight: str) -> DataFrame:
    return df.withColumn("turn", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(weight)))))


def chunk_number(rank: str, size: int) -> Column:
    return F.floor((F.col(rank) - 1) / F.lit(size)).cast("long")


def rotating_slice(df: DataFrame, ring: str, rank: str, offset: int, k: int) -> DataFrame:
    """k consecutive entries of each whole ring, starting at ``offset``; a ring's length is its number of entries."""
    sizes = df.groupBy(ring).agg(F.count(F.lit(1)).alias("__size"))
    joined = df.join(sizes.withColumnRenamed(ring, "__ring"), F.col(ring).eqNullSafe(F.col("__ring")))
    return joined.where(F.pmod(F.col(rank) - 1 - F.lit(offset), F.col("__size")) < k).drop("__ring", "__size")


# --- relevance bands -----------------------------------------------------------------------------


def relevance_bands(rows: DataFrame, rank: str, score: str, high_floor: float = 50.0, medium_floor: float = 34.0) -> DataFrame:
    """high / medium / low: the first eligible rows fill the high band, the next eligible ones the medium band.

    Band sizes follow from the number of rows (48 and 45 on boards of a hundred or more)."""
    rows = materialise(rows, "bands")  # a board, read several times below
    n = rows.agg(F.count(F.lit(1))).scalar()
    df = rows.withColumn("__n", n).withColumn("__h", F.col(score) >= high_floor)
    half_up = lambda x: F.floor(x + 0.5)
    high_min = F.when(F.col("__n") >= 100, 30).otherwise(F.greatest(F.lit(1), half_up(F.col("__n") * 0.25)))
    high_max = F.when(F.col("__n") >= 100, 48).otherwise(F.greatest(high_min, half_up(F.col("__n") * 0.52)))
    low_max = F.when(F.col("__n") >= 100, 25).otherwise(F.ceil(F.col("__n") * 0.25))
    medium_min = F.when(F.col("__n") >= 100, 32).otherwise(F.greatest(F.lit(0), F.col("__n") - high_min - low_max))
    medium_max = F.when(F.col("__n") >= 100, 45).otherwise(F.greatest(medium_min, F.col("__n") - high_min))
    one = global_rank(df.where("__h"), [F.col(rank).asc()], "__place").unionByName(df.where("NOT __h").withColumn("__place", F.lit(None).cast("long")))
    one = one.withColumn("__high", F.coalesce(F.col("__place") <= high_max, F.lit(False))).drop("__place")
    open_ = ~F.col("__high") & (F.col(score) >= medium_floor)
    two = global_rank(one.where(open_), [F.col(rank).asc()], "__place").unionByName(
        one.where(~open_).withColumn("__place", F.lit(None).cast("long")))
    band = F.when(F.col("__high"), "high").when(F.col("__place") <= medium_max, "medium").otherwise("low")
    return two.withColumn("band", band).drop("__n", "__h", "__high", "__place")


def narrative_quality(meme: str, visual: str, conf: str, dry: str, evidence: str, sources: str, archetype: str, age_h: str) -> Column:
    bonus = (
        F.when(c(archetype) == "mascot", 8).when(c(archetype) == "visual_absurdity", 7).when(c(archetype) == "catchphrase", 5)
        .when(c(archetype) == "personality", 4).when(c(archetype) == "community_joke", 3).when(c(archetype) == "pop_culture", 2)
        .when(c(archetype) == "tech_drama", -2).when(c(archetype) == "political_meme", -4).otherwise(0)
    )
    recent = F.when(c(age_h).isNull(), 0).otherwise(sc.ladder(age_h, ((6, 9), (24, 6), (72, 3)), 0))
    return (
        c(meme) * 0.48 + c(visual) * 0.2 + c(conf) * 100 * 0.18 + F.least(F.lit(20), c(evidence) * 4 + c(sources) * 2) + bonus + recent
        - c(dry) * 0.22
    )


# --- fixed values: category and culture bonuses of the matching priority ----------------------
CATEGORY_BONUS = {
    "meme": 20.0, "internet_culture": 18.0, "crypto_spillover": 17.0, "entertainment": 16.0, "gaming": 16.0, "creator": 14.0, "ai_tech": 14.0,
    "memeified_politics": 10.0, "politics": -18.0, "macro": -12.0, "finance": -12.0, "news": -8.0,
}
CULTURE_BONUS = {
    "meme": 8.0, "internet_culture": 7.0, "crypto_spillover": 7.0, "gaming": 7.0, "entertainment": 6.0, "creator": 6.0, "ai_tech": 5.0,
    "memeified_politics": 4.0,
}


def _lookup(x: str, table: dict[str, float]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), F.col(x)), F.lit(0.0))


def category_bonus(bucket: str) -> Column:
    return _lookup(bucket, CATEGORY_BONUS)


def culture_bonus(hits: str, entities: str, bucket: str, posts: str) -> Column:
    active = F.when(c(posts) >= 10, 3.0).when(c(posts) >= 6, 1.5).otherwise(0.0)
    return F.least(F.lit(18.0), c(hits) * 1.8 + F.least(F.lit(8.0), c(entities) * 1.2) + _lookup(bucket, CULTURE_BONUS) + active)


def topic_quality_penalty(confidence: str, posts: str, generic: Column, entities: str, failed: Column, weak_status: Column, bucket: str) -> Column:
    """Penalty of weakly supported, generically named or newsy topics."""
    conf = F.when(c(confidence) <= 0, 8.0).when(c(confidence) < 0.2, 6.0).otherwise(0.0)
    few = sc.ladder(posts, ((2, 10.0), (4, 6.0), (6, 2.0)), 0.0)
    pts = lambda cond, x: F.when(cond, x).otherwise(0.0)
    return (
        pts(weak_status, 18.0) + conf + few + pts(failed, 6.0) + pts(generic, 16.0) + pts(generic & (c(entities) == 0), 8.0)
        + pts(c(bucket).isin("politics", "macro", "finance", "news"), 6.0)
    )
