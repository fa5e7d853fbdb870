"""Row normalisation, retention, scoping, unions, source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.basic import blank_to_null, c, epoch, round1
from tidegauge.functions.scores import source_status
from tidegauge.operators.windows import best


def settle_times(df: DataFrame, created: str, indexed: str, ingested: str) -> DataFrame:
    """created ▸ indexed ▸ ingested; more than five minutes in the future of the arrival counts as wrong."""
    limit = F.col(ingested) + F.expr("INTERVAL 5 MINUTES")
    first = F.coalesce(created, indexed, ingested)
    safe = F.when(F.col(indexed) <= limit, F.col(indexed)).otherwise(F.col(ingested))
    return df.withColumn("created_at", F.when(first > limit, safe).otherwise(first))


def last_wins(df: DataFrame, key: list[str], sequence: str) -> DataFrame:
    return best(df, key, [F.col(sequence).desc()])


# raw events: one JSON payload per event, as a typed struct
EVENT = "kind string, did string, time_us long, commit struct<operation: string, collection: string, rkey: string, record: struct<text: string, createdAt: string, reply: struct<parent: string, root: string>, quote: string, subject: string>>"


def parse_events(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.from_json(payload, EVENT).alias("e")).select(*keep, "e.*")


def post_type(record: str) -> Column:
    return F.when(F.col(f"{record}.reply.parent").isNotNull(), "reply").when(F.col(f"{record}.quote").isNotNull(), "quote").otherwise("root")


def event_posts(events: DataFrame, *keep: str) -> DataFrame:
    """Post rows of the created posts; title and summary are the cleaned text."""
    r = "commit.record"
    posts = events.where("kind = 'commit' AND commit.operation = 'create' AND commit.collection = 'post'")
    uri = F.concat_ws("/", F.lit("at:/"), "did", "commit.collection", "commit.rkey")
    return posts.select(
        *keep, uri.alias("uri"), "did", post_type(r).alias("post_type"), F.trim(F.regexp_replace(f"{r}.text", r"\s+", " ")).alias("text"),
        F.coalesce(f"{r}.reply.root", f"{r}.reply.parent", uri).alias("root"), F.col(f"{r}.reply.parent").alias("parent"), F.col(f"{r}.quote").alias("quoted"),
        F.timestamp_micros("time_us").cast("timestamp_ntz").alias("event_at"),
    )


def event_interactions(events: DataFrame, posts: DataFrame) -> DataFrame:
    """Likes and reposts of subjects, plus the reply and quote edges of posts, with composed ids."""
    edges = events.where("kind = 'commit' AND commit.operation = 'create' AND commit.collection IN ('like', 'repost')").select(
        "did", F.col("commit.collection").alias("kind"), F.col("commit.record.subject").alias("target"))
    replies = posts.where("post_type = 'reply'").select("did", F.lit("reply").alias("kind"), F.col("parent").alias("target"))
    quotes = posts.where("post_type = 'quote'").select("did", F.lit("quote").alias("kind"), F.col("quoted").alias("target"))
    return edges.unionByName(replies).unionByName(quotes).where("target IS NOT NULL").withColumn("id", F.concat_ws(":", "kind", "did", "target"))


def carry_forward(incoming: DataFrame, previous: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields the new row does not bring are taken from the stored row."""
    p = previous.select(key, *[F.col(f).alias(f"p_{f}") for f in fields])
    rest = [x for x in incoming.columns if x not in fields]
    return incoming.join(p, key, "left").select(*rest, *[F.coalesce(f, f"p_{f}").alias(f) for f in fields])


def window_prune(parents: DataFrame, children: DataFrame, parent: str, child_parent: str, p_ts: str, c_ts: str, as_of: Column, hours: int = 168):
    """Parents in the window; children in the window whose parent stays."""
    cut = as_of - F.make_interval(hours=F.lit(hours))
    kept = parents.where(F.col(p_ts) >= cut)
    inside = children.where(F.col(c_ts) >= cut)
    return kept, inside.join(kept.select(F.col(parent).alias(child_parent)), child_parent, "left_semi")


def retain(rows: DataFrame, key: str, ts: str, cut: Column, active: DataFrame) -> DataFrame:
    """Recent rows and rows something still refers to."""
    flag = active.select(F.col(active.columns[0]).alias(key)).distinct().withColumn("__active", F.lit(True))
    return rows.join(flag, key, "left").where((F.col(ts) >= cut) | F.col("__active").isNotNull()).drop("__active")


def scope_lookback(parents: DataFrame, children: DataFrame, key: str, ts: str, as_of: Column, range_seconds: int) -> DataFrame:
    """Parents of twice the range (seven days at most), or with a child active in the range."""
    span = min(7 * 86400, 2 * range_seconds)
    cut = as_of - F.make_interval(secs=F.lit(span))
    active = children.where(F.col(ts) >= as_of - F.make_interval(secs=F.lit(range_seconds))).select(key)
    return retain(parents, key, ts, cut, active)


def prune_count(rows: DataFrame, ts: str, cut: Column) -> DataFrame:
    return rows.agg(F.count_if(F.col(ts) < cut).alias("deleted"), F.count_if(F.col(ts) >= cut).alias("kept"))


def unite(documents: dict[str, DataFrame]) -> DataFrame:
    """Documents of different kinds in one schema; fields a kind lacks are NULL."""
    out = None
    for kind, df in documents.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def drop_known(items: DataFrame, native: DataFrame, key: str) -> DataFrame:
    return items.join(native.select(key), key, "left_anti")


def delta_documents(deltas: DataFrame, posts: DataFrame, post: str, score: str) -> DataFrame:
    """Snapshot changes as documents of their post; no post or no score, no document."""
    return deltas.where(F.col(score) > 0).join(posts, post, "inner")


def source_health(sources: DataFrame, as_of: Column, last: str, failures: str) -> DataFrame:
    age = F.when(F.col(last).isNotNull(), F.round((epoch(as_of) - epoch(last)) / 60, 1))
    df = sources.withColumn("age_minutes", age)
    return df.withColumn("health", source_status("age_minutes", failures)).select("*", "health.status", "health.score").drop("health")


def health_summary(health: DataFrame, covered: Column, complete: Column) -> DataFrame:
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    pct = lambda cond: round1(F.count_if(cond) / n * 100)
    out = health.agg(
        F.count(F.lit(1)).alias("sources"), pct(F.col("age_minutes") <= 60).alias("refreshed_1h_pct"), pct(F.col("age_minutes") <= 360).alias("refreshed_6h_pct"),
        pct(F.col("age_minutes") <= 1440).alias("coverage_score"), round1(F.avg("age_minutes")).alias("average_age"), round1(F.sum("score") / n).alias("freshness_score"),
        pct(covered).alias("covered_pct"), pct(complete).alias("complete_pct"),
    )
    return out.withColumn("completeness", F.least(F.lit(100.0), round1(F.col("complete_pct") * 0.7 + F.col("covered_pct") * 0.3)))


def success_rate(runs: DataFrame, order: list[Column], status: str, n: int = 20) -> DataFrame:
    recent = runs.orderBy(*order).limit(n)
    return recent.agg(round1(F.avg(F.when(F.col(status) == "success", 1.0).when(F.col(status) == "partial", 0.5).otherwise(0.0)) * 100).alias("success_rate"))


def breakdown(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts per value of several columns, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("dimension"), F.coalesce(F.col(x).cast("string"), F.lit("unknown")).alias("value")) for x in columns]))
    return rows.select(pairs.alias("x")).select("x.*").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def freshness_probe(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Latest timestamp of every table; each is one aggregate over one column."""
    out = None
    for name, (df, ts) in tables.items():
        one = df.agg(F.max(ts).alias("latest"), F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def strongest(rows: DataFrame, group: str, score: str, title: str) -> DataFrame:
    """Best score, matched queries and their number per group."""
    return rows.groupBy(group).agg(
        F.max(score).alias("score"), F.max_by(title, F.struct(score, title)).alias("strongest"), F.count_distinct(F.trim(title)).alias("queries"))


def latest_state_coverage(topics: DataFrame, states: DataFrame, key: str, ts: str, status: str) -> DataFrame:
    last = states.groupBy(key).agg(F.max_by(status, ts).alias("s"))
    s = F.coalesce("s", F.lit("missing"))
    return topics.join(last, key, "left").agg(
        F.count(F.lit(1)).alias("topics"), *[F.count_if(s == x).alias(x) for x in ("ready", "pending", "failed", "missing")])


def rotation_coverage(sources: DataFrame, due: Column, complete: Column) -> DataFrame:
    out = sources.agg(F.count(F.lit(1)).alias("sources"), F.count_if(due).alias("due"), F.count_if(complete).alias("complete"))
    pct = round1(F.col("complete") / F.greatest(F.col("sources"), F.lit(1)) * 100)
    return out.withColumn("complete_pct", pct).withColumn("phase", F.when(pct >= 100, "live").when(F.col("complete") > 0, "backfill").otherwise("empty"))


def first_trend_wins(trends: DataFrame, messages: DataFrame, trend: str, ids: str, message: str, weight: str) -> DataFrame:
    """Every message belongs to the first trend that names it; totals per trend."""
    claims = trends.select(trend, F.explode(ids).alias(message))
    owned = claims.groupBy(message).agg(F.min(trend).alias(trend))
    return owned.join(messages, message).groupBy(trend).agg(F.count(F.lit(1)).alias("messages"), F.sum(weight).alias("engagement"))


def flatten_thread(items: DataFrame, payload: str, schema: str, key: str) -> DataFrame:
    """Nested comment threads -> one row per comment and reply."""
    top = items.select(key, F.inline(F.from_json(payload, schema)))
    comments = top.select(key, "id", F.lit(None).cast("string").alias("parent"), "likes")
    replies = top.select(key, F.col("id").alias("parent"), F.inline("replies")).select(key, "id", "parent", "likes")
    return comments.unionByName(replies)


def unique_slugs(rows: DataFrame, title: str, key: str) -> DataFrame:
    """URL-safe slugs; repeats of a slug get a counting suffix."""
    from tidegauge.operators.windows import chunked_rank

    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    base = rows.withColumn("base", F.when(slug == "", "narrative").otherwise(slug))
    numbered = chunked_rank(base, ["base"], [F.col(key).asc()], "n")
    return numbered.withColumn("slug", F.when(F.col("n") > 1, F.concat_ws("-", "base", F.col("n").cast("string"))).otherwise(F.col("base"))).drop("base", "n")


def evidence_support(labels: DataFrame, evidence: DataFrame, topic: str, label_tokens: str, evidence_tokens: str) -> DataFrame:
    """Share of a label's words found in the evidence texts of its topic."""
    words = labels.select(topic, F.explode(F.array_distinct(label_tokens)).alias("w"))
    seen = evidence.select(topic, F.explode(evidence_tokens).alias("w")).distinct().withColumn("hit", F.lit(1))
    return words.join(seen, [topic, "w"], "left").groupBy(topic).agg(
        F.count(F.lit(1)).alias("words"), F.sum(F.coalesce("hit", F.lit(0))).alias("supported")).withColumn("support", F.col("supported") / F.col("words"))
