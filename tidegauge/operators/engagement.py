"""Interactions, cascades, amplifiers, snapshots, author rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions import scores as sc
from tidegauge.functions.basic import c, count_true, epoch, round1
from tidegauge.operators.windows import chunked_lag, share_of_total, top_n

# --- fixed values: amplification weights -----------------------------------------------
AMPLIFY = {"like": 1.0, "repost": 3.0, "reply": 4.0, "quote": 4.5}
CASCADE = {"quote": 4, "reply": 3, "repost": 2}
SPREAD = {"quote": 5, "reply": 4, "repost": 3}


def weight(kind: str, table: dict, other) -> Column:
    out = None
    for name, value in table.items():
        out = (F if out is None else out).when(c(kind) == name, value)
    return out.otherwise(other)


def observed_counts(interactions: DataFrame, post: str, kind: str = "kind") -> DataFrame:
    """Likes, reposts, replies and quotes per post in one pass (map-side combined, so hot posts are no issue)."""
    return interactions.where(c(post).isNotNull()).groupBy(post).agg(
        *[count_true(c(kind) == k).alias(name) for k, name in
          (("like", "likes"), ("repost", "reposts"), ("reply", "replies"), ("quote", "quotes"))]
    )


def hydrate(posts: DataFrame, counts: DataFrame, profiles: DataFrame, post: str, author: str) -> DataFrame:
    """Posts with observed counts, profile fields, score and priority."""
    p = profiles.select(F.col(author), F.col("handle").alias("p_handle"), F.col("followers").alias("p_followers"))
    df = posts.join(counts, post, "left").fillna(0, ["likes", "reposts", "replies", "quotes"]).join(p, author, "left")
    return df.select(
        post, author, F.coalesce("p_handle", F.col(author).cast("string")).alias("handle"), F.col("p_followers").alias("followers"),
        "likes", "reposts", "replies", "quotes",
        F.greatest(F.lit(1), F.col("likes") + F.col("reposts") * 3 + F.col("quotes") * 4 + F.col("replies") * 4).alias("score"),
        sc.post_priority("reposts", "quotes", "replies", "likes").alias("priority"),
    )


def actor_activity(posts: DataFrame, interactions: DataFrame, actor: str, target: str, ts: str) -> DataFrame:
    """Posts, weighted amplification, last activity and last target per actor; one aggregation over both inputs."""
    rows = posts.select(actor, ts, F.lit(0).alias("is_i"), F.col(target).alias("target"), F.lit(0.0).alias("w"), F.lit(1).alias("p"))
    rows = rows.unionByName(interactions.select(
        actor, ts, F.lit(1).alias("is_i"), F.col(target).alias("target"), weight("kind", AMPLIFY, 0.5).alias("w"), F.lit(0).alias("p")
    ))
    return rows.groupBy(actor).agg(
        F.sum("p").alias("post_count"), F.round(F.sum("w"), 1).alias("amplification"), F.max(ts).alias("last_activity"),
        F.max_by("target", F.struct("is_i", ts, "target")).alias("last_target"),
    )


def snapshot_deltas(snaps: DataFrame, key: str, ts: str, counters: list[str]) -> DataFrame:
    """Change of every counter against the previous snapshot (never below zero) and minutes between them.

    An item with very many snapshots is cut into ranges of time and is not one task."""
    df = chunked_lag(snaps, [key], [ts], [ts, *counters])
    gap = F.when(F.col(f"prev_{ts}").isNotNull(), F.round((epoch(ts) - epoch(f"prev_{ts}")) / 60, 1)).otherwise(0.0)
    return df.select(
        *snaps.columns, gap.alias("delta_minutes"),
        *[F.greatest(F.lit(0), F.col(x) - F.coalesce(f"prev_{x}", F.lit(0))).alias(f"delta_{x}") for x in counters],
    )


def snapshot_context(snaps: DataFrame, key: str, ts: str, counters: list[str]) -> DataFrame:
    return snaps.groupBy(key).agg(
        F.count(F.lit(1)).alias("snapshots"), F.min(ts).alias("first_at"), F.max(ts).alias("latest_at"),
        *[F.min_by(x, ts).alias(f"first_{x}") for x in counters], *[F.max_by(x, ts).alias(f"latest_{x}") for x in counters],
    )


def cascades(posts: DataFrame, interactions: DataFrame, hours: float, limit: int | None = 6) -> DataFrame:
    """Roots by weighted interactions, with participants, span, velocity and share of everything."""
    rows = posts.select("root", "actor", "ts", F.lit(1).alias("w")).unionByName(
        interactions.select("root", "actor", "ts", weight("kind", CASCADE, 1).alias("w"))
    )
    agg = rows.groupBy("root").agg(
        F.sum("w").alias("interactions"), F.count_distinct("actor").alias("participants"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    out = share_of_total(agg, "interactions", "share").withColumn("share_pct", round1("share")).drop("share")
    out = out.withColumn("velocity", round1(F.col("interactions") / F.lit(max(hours, 0.25))))
    if limit is None:
        return out
    return out.orderBy(F.desc("interactions"), F.desc("participants"), "root").limit(limit)


def amplifiers(posts: DataFrame, interactions: DataFrame, limit: int | None = 8) -> DataFrame:
    """Actors by weighted interactions; reply and quote posts count for their author."""
    rows = interactions.select("actor", weight("kind", SPREAD, 1).alias("w")).unionByName(
        posts.where(F.col("kind").isin("reply", "quote")).select("actor", weight("kind", SPREAD, 1).alias("w"))
    )
    agg = rows.groupBy("actor").agg(F.sum("w").alias("interactions"), F.count(F.lit(1)).alias("documents"))
    out = share_of_total(agg, "interactions", "s").withColumn("contribution_pct", round1("s")).drop("s")
    if limit is None:
        return out
    return out.orderBy(F.desc("interactions"), F.desc("documents"), "actor").limit(limit)


def amplifier_edges(interactions: DataFrame, top_cascades: DataFrame, top_actors: DataFrame, limit: int = 18) -> DataFrame:
    """Weights of the edges from leading actors to leading cascades."""
    return (
        interactions.join(top_cascades.select("root"), "root", "left_semi").join(top_actors.select("actor"), "actor", "left_semi")
        .groupBy("actor", "root").agg(F.sum(weight("kind", CASCADE, 1)).alias("edge_weight"))
        .orderBy(F.desc("edge_weight"), "actor", "root").limit(limit)
    )


def stream_overview(posts: DataFrame, interactions: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """One row: rates per minute, accounts, noise share of leading cascades, intensity, acceleration."""
    p = posts.select(F.lit("post").alias("kind"), "actor", "ts", F.when(F.col("kind") == "root", 4).otherwise(3).alias("w"))
    i = interactions.select("kind", "actor", "ts", weight("kind", CASCADE, 1).alias("w"))
    start = as_of - F.make_interval(mins=F.lit(minutes))
    slot = F.least(F.lit(23), F.floor((epoch("ts") - epoch(start)) / F.lit(minutes * 60 / 24)))
    inside = F.col("ts").between(start, as_of)
    rate = lambda k: round1(F.count_if(F.col("kind") == k) / F.lit(max(minutes, 5)))
    one = p.unionByName(i).agg(
        F.count_distinct("actor").alias("account_spread"), F.count_if(F.col("kind") == "post").alias("posts"),
        rate("post").alias("posts_per_minute"), rate("like").alias("likes_per_minute"), rate("repost").alias("reposts_per_minute"),
        rate("reply").alias("replies_per_minute"), rate("quote").alias("quotes_per_minute"),
        F.sum(F.when(inside & (slot >= 18), F.col("w")).otherwise(0)).alias("recent"),
        F.sum(F.when(inside & (slot >= 12) & (slot < 18), F.col("w")).otherwise(0)).alias("prior"),
    )
    noise = cascades(posts, interactions, minutes / 60).agg(
        F.sum("interactions").alias("n_all"),
        F.sum(F.when((F.col("participants") < 3) & (F.col("interactions") < 10), F.col("interactions")).otherwise(0)).alias("n_noise"),
    )
    one = one.withColumn("noise_ratio_pct", noise.select(
        F.when(F.col("n_all") > 0, round1(F.col("n_noise") / F.col("n_all") * 100)).otherwise(0.0)).scalar())
    intensity = round1(
        F.col("posts") * 4 + F.col("likes_per_minute") * 2 + F.col("reposts_per_minute") * 16 + F.col("replies_per_minute") * 18
        + F.col("quotes_per_minute") * 20
    )
    one = one.withColumn("engagement_intensity", intensity)
    return one.withColumn("meaningful_attention", round1(
        F.col("engagement_intensity") * F.greatest(F.lit(1.0), F.log2(F.col("account_spread") + 1))
        * F.greatest(F.lit(0.25), 1 - F.col("noise_ratio_pct") / 100)
    )).withColumn("acceleration", F.when(F.col("prior") > 0, round1((F.col("recent") - F.col("prior")) / F.col("prior") * 100))
                  .otherwise(F.when(F.col("recent") > 0, 100.0).otherwise(0.0))).drop("recent", "prior")


def platform_breakdown(docs: DataFrame, group: str, platform: str, weight_col: str) -> DataFrame:
    """Share of every platform in a group: aggregate first, window over a handful of rows per group."""
    from pyspark.sql import Window

    agg = docs.groupBy(group, platform).agg(F.sum(F.greatest(F.lit(0.0), c(weight_col))).alias("interactions"))
    total = F.sum("interactions").over(Window.partitionBy(group))
    return agg.withColumn("share_pct", F.when(total > 0, round1(F.col("interactions") / total * 100)).otherwise(0.0))


def concentration(docs: DataFrame, group: str, root: str, author: str) -> DataFrame:
    """Share of the largest root and of the busiest author per group, with distinct counts."""
    by_root = docs.groupBy(group, root).agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(
        F.sum("n").alias("documents"), F.max("n").alias("m"), F.count(F.lit(1)).alias("roots"))
    by_author = docs.groupBy(group, author).agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(
        F.max("n").alias("a"), F.count(F.lit(1)).alias("authors"))
    return by_root.join(by_author, group).select(
        group, "documents", "roots", "authors", (F.col("m") / F.col("documents")).alias("top_root_share"),
        (F.col("a") / F.col("documents")).alias("single_author_share"),
    )


def group_freshness(docs: DataFrame, group: str, platform: str, score: str, interactions: str) -> DataFrame:
    """Interaction-weighted freshness per platform, mean over platforms, mixed-age state, confirmed spread."""
    w = 1 + F.least(F.lit(2.8), F.log10(F.greatest(c(interactions), F.lit(0)) + 1))
    per = docs.groupBy(group, platform).agg((F.sum(c(score) * w) / F.greatest(F.sum(w), F.lit(1.0))).alias("raw"))
    per = per.withColumn("s", round1("raw"))
    out = per.groupBy(group).agg(
        round1(F.avg("s")).alias("score"), F.count_if(F.col("s") >= 55).alias("confirmed_spread"),
        F.max((F.col("s") < 42).cast("int")).alias("old"), F.max((F.col("s") >= 68).cast("int")).alias("young"),
    )
    return out.select(group, "score", "confirmed_spread", F.when((F.col("old") == 1) & (F.col("young") == 1), "mixed")
                      .otherwise(sc.freshness_state("score")).alias("state"))


def unique_interactions(docs: DataFrame, group: str, root: str, root_total: str) -> DataFrame:
    """Sum of per-root totals, every root counted once per group."""
    return docs.groupBy(group, root).agg(F.max(root_total).alias("v")).groupBy(group).agg(F.sum("v").alias("interactions"))


def group_velocity(deltas: DataFrame, group: str, minutes: str, cols: dict[str, str]) -> DataFrame:
    """Hourly velocities from snapshot deltas and the leading signal."""
    hours = F.greatest(F.sum(F.greatest(c(minutes) / 60, F.lit(0.25))), F.lit(0.25))
    out = deltas.groupBy(group).agg(
        *[round1(F.sum(v) / hours).alias(f"{k}_velocity") for k, v in cols.items()], F.count_distinct("actor").alias("authors"),
    )
    q, r, p = F.col("quote_velocity"), F.col("repost_velocity"), F.col("reply_velocity")
    signal = (
        F.when((q >= r) & (q >= p) & (q > 0), "Quote burst").when((r >= p) & (r > 0), "Repost cascade").when(p > 0, "Reply surge")
        .when(F.col("authors") >= 6, "Cross-account spread").otherwise("Steady attention")
    )
    return out.withColumn("leading_signal", signal)


def author_merge(rows: DataFrame, key: str, order: str, first: str, last: str, fields: list[str]) -> DataFrame:
    """One row per author: last known value of every field, earliest first and latest last sighting."""
    return rows.groupBy(key).agg(
        *[F.max_by(f, F.when(c(f).isNotNull(), c(order))).alias(f) for f in fields],
        F.min(first).alias("first_seen_at"), F.max(last).alias("last_seen_at"),
    )


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], first: str, fields: list[str]) -> DataFrame:
    """Incoming over stored, keeping the first sighting; NULLs in the incoming row do not erase."""
    both = stored.withColumn("__v", F.lit(0)).unionByName(incoming.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    return both.groupBy(*key).agg(
        *[F.max_by(f, F.when(c(f).isNotNull(), F.col("__v"))).alias(f) for f in fields],
        F.min_by(first, "__v").alias(first), F.max("__v").alias("touched"),
    )


def keep_last(snaps: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return top_n(snaps, [key], order, n)
