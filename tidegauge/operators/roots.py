"""Root posts: found through reply edges of any depth, consolidated with what refers to them, grouped by their best topic key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions import scores as sc
from tidegauge.functions.basic import Col, barrier, c
from tidegauge.operators.windows import top_n
from tidegauge.session import materialise

# --- fixed values: kinds of topic keys of a root: priority, how many per root ------------------------------------
CANDIDATE_KINDS = {"hybrid": (460, 1), "entity": (360, 3), "phrase": (300, 3), "hashtag": (240, 2), "url": (140, 2)}


def find_roots(posts: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root) of every post, by pointer doubling over reply edges.

    Every round replaces a post's pointer by its pointer's pointer, so a chain of n replies takes log2(n) rounds; posts that have reached their root leave the
    rounds.  A parent that is no post itself is a root.  Posts on a reply loop, or above one, have no root (NULL).  A post with several parents keeps the
    smallest."""
    edges = posts.groupBy(c(node).alias("x")).agg(F.min(parent).alias("p"))
    edges = materialise(edges.select("x", F.when(F.col("p") != F.col("x"), F.col("p")).alias("p")), "reply-edges")
    known = edges.where("p IS NOT NULL")
    found = edges.where("p IS NULL").select("x", F.col("x").alias("root"))
    # a pointer is final once it points to a post without a parent, or to none of the posts
    state = known.join(known.select(F.col("x").alias("p"), F.lit(False).alias("inner")), "p", "left").select("x", "p", F.coalesce("inner", F.lit(True)).alias("final"))
    state = materialise(state, "reply-pointers")
    done = [found, state.where("final").select("x", F.col("p").alias("root"))]
    open_ = state.where("NOT final")
    while not open_.isEmpty():
        pointers = state.select(F.col("x").alias("p"), F.col("p").alias("q"), F.col("final").alias("f"))
        moved = open_.drop("final").join(pointers, "p").select("x", F.col("q").alias("p"), F.col("f").alias("final"))
        moved = materialise(moved, "reply-pointers")
        if moved.where("final").isEmpty():
            break  # only loops are left
        done.append(moved.where("final").select("x", F.col("p").alias("root")))
        state = materialise(state.where("final").unionByName(moved), "reply-pointers")
        open_ = state.where("NOT final")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    every = edges.select("x").join(out, "x", "left")
    return every.select(F.col("x").alias(node), "root")


def consolidate(posts: DataFrame, actions: DataFrame, node: str, subject: str, actor: str, ts: str, as_of: Column, hours: int = 24) -> DataFrame:
    """One row per root: posts, interactions (all, and of the last hours), distinct authors and actors, first and last seen, author and text of its earliest post.

    posts: node, root, actor, ts, text.  actions name a post (or a root) as their subject.  Counts are folded before they are shuffled; distinct actors go
    by (root, actor), never as a list per root."""
    targets = posts.select(c(node).alias("s"), F.col("root").alias("r"))
    acts = actions.select(c(subject).alias("s"), c(actor).alias("who"), c(ts).alias("at")).join(targets, "s", "left").select(F.coalesce("r", "s").alias("root"), "who", "at", F.lit(0).alias("post"))
    rows = posts.where("root IS NOT NULL").select("root", c(actor).alias("who"), c(ts).alias("at"), F.lit(1).alias("post")).unionByName(acts)
    recent = F.col("at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")
    by_actor = rows.where("root IS NOT NULL").groupBy("root", "who").agg(
        F.sum("post").alias("posts"), F.sum(1 - F.col("post")).alias("interactions"), F.count_if(recent & (F.col("post") == 0)).alias("recent"), F.min("at").alias("first"), F.max("at").alias("last"))
    totals = by_actor.groupBy("root").agg(F.sum("posts").alias("posts"), F.sum("interactions").alias("interactions"), F.sum("recent").alias("recent_interactions"), F.count("who").alias("authors"),
                                          F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))
    earliest = posts.where("root IS NOT NULL").groupBy("root").agg(F.min_by(F.struct(c(actor).alias("primary_author"), F.col("text").alias("root_text")), F.struct(c(ts), c(node))).alias("e"))
    return totals.join(earliest, "root", "left").select(*totals.columns, "e.primary_author", "e.root_text")


def candidate_keys(posts: DataFrame, signals: dict[str, Col]) -> DataFrame:
    """(root, kind, key, support, priority): topic keys of every root, the best supported of each kind.

    ``signals``: an array column of keys for each kind of CANDIDATE_KINDS but ``hybrid``, which joins the best entity and the best phrase where they
    differ.  Support is how many of the root's posts hold the key."""
    named = lambda kind: lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    tagged = F.flatten(F.array(*[F.transform(F.array_distinct(c(keys)), named(kind)) for kind, keys in signals.items()]))
    support = posts.where("root IS NOT NULL").select("root", F.explode(tagged).alias("s")).where("s.key IS NOT NULL AND s.key <> ''").groupBy("root", "s.kind", "s.key").agg(F.count(F.lit(1)).alias("support"))
    places = top_n(support, ["root", "kind"], [F.col("support").desc(), F.col("key").asc()], 3, "place")
    limit = F.coalesce(*[F.when(F.col("kind") == kind, most) for kind, (_, most) in CANDIDATE_KINDS.items()])
    kept = barrier(places.where(F.col("place") <= limit))
    first = lambda kind, name: kept.where((F.col("kind") == kind) & (F.col("place") == 1)).select("root", F.col("key").alias(name), F.col("support").alias(f"n_{name}"))
    hybrid = first("entity", "e").join(first("phrase", "p"), "root").where("e <> p").select(
        "root", F.lit("hybrid").alias("kind"), F.concat_ws("__", "e", "p").alias("key"), F.least("n_e", "n_p").alias("support"))
    every = kept.drop("place").unionByName(hybrid)
    priority = F.coalesce(*[F.when(F.col("kind") == kind, weight) for kind, (weight, _) in CANDIDATE_KINDS.items()])
    return every.withColumn("priority", priority)


def root_groups(roots: DataFrame, candidates: DataFrame) -> DataFrame:
    """(root, group): every root under its candidate key of highest priority (then support, then key); roots without one are groups of their own."""
    best = top_n(candidates, ["root"], [F.col("priority").desc(), F.col("support").desc(), F.col("key").asc()], 1)
    named = best.select("root", F.concat_ws(":", "kind", "key").alias("group"))
    return roots.select("root").join(named, "root", "left").select("root", F.coalesce("group", F.concat(F.lit("root:"), F.col("root").cast("string"))).alias("group"))


def group_seeds(roots: DataFrame, groups: DataFrame, activity: DataFrame, ts: str, as_of: Column, window_hours: int = 24) -> DataFrame:
    """One row per group: roots, posts, interactions, authors of its roots, share of the strongest root, windows before and after, lift, age, recency, support.

    ``activity``: (root, ts) of every interaction.  Two windows of equal length end at ``as_of``.  Authors add up over roots."""
    hours = lambda n: as_of - F.expr(f"INTERVAL {n} HOURS")
    at = c(ts)
    windows = activity.where((at >= hours(2 * window_hours)) & (at <= as_of)).groupBy("root").agg(F.count_if(at > hours(window_hours)).alias("current"), F.count_if(at <= hours(window_hours)).alias("prior"))
    rows = roots.join(groups, "root").join(windows, "root", "left")
    seeds = rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("roots"), F.sum("posts").alias("posts"), F.sum("interactions").alias("interactions"), F.sum("authors").alias("authors"), F.max("interactions").alias("top_root"),
        F.coalesce(F.sum("current"), F.lit(0)).alias("current"), F.coalesce(F.sum("prior"), F.lit(0)).alias("prior"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    minutes = F.greatest(F.lit(1), F.round((as_of.cast("timestamp").cast("double") - F.col("first_seen").cast("timestamp").cast("double")) / 60).cast("long"))
    seeds = seeds.withColumn("concentration", F.col("top_root") / F.greatest("interactions", F.lit(1))).withColumn("first_seen_minutes", minutes).withColumn("lift", sc.lift("current", "prior"))
    recency = sc.ladder("first_seen_minutes", ((60, 100), (360, 88), (720, 72), (1440, 54), (2880, 34)), 16)
    return seeds.withColumn("recency", recency).withColumn("has_support", has_support("authors", "roots", "posts", "interactions")).drop("top_root")


def has_support(authors: Col, roots: Col, documents: Col, comments: Col) -> Column:
    """Enough independent voices: two authors over two roots, three documents, or eight comments."""
    return (c(authors) >= 2) & (c(roots) >= 2) | (c(documents) >= 3) | (c(comments) >= 8)


__all__ = ["CANDIDATE_KINDS", "candidate_keys", "consolidate", "find_roots", "group_seeds", "has_support", "root_groups"]
