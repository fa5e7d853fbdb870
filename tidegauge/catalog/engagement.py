"""Interactions, cascades, amplifiers, snapshots, authors, interaction scores."""

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import big, r6, ts
from tidegauge.functions import scores as sc
from tidegauge.operators import engagement as en
from tidegauge.plans import standins as st

# events as a social graph: view = root post, purchase = quote post, error = reply post, click = repost, signup = like
_KIND = "CASE event_type WHEN 'view' THEN 'root' WHEN 'purchase' THEN 'quote' WHEN 'error' THEN 'reply' WHEN 'click' THEN 'repost' ELSE 'like' END"
G = f"""{st.ACTIONS_SQL}, g AS (SELECT event_id, ts, user_id AS actor, k AS root, {_KIND} AS kind, value FROM actions),
p AS (SELECT * FROM g WHERE kind IN ('root', 'quote', 'reply')), i AS (SELECT * FROM g WHERE kind NOT IN ('root', 'quote', 'reply'))"""


def graph(spark, sf):
    return st.actions(spark, sf).selectExpr("event_id", "ts", "user_id AS actor", "k AS root", f"{_KIND} AS kind", "value")


def posts(spark, sf):
    return graph(spark, sf).where("kind IN ('root', 'quote', 'reply')")


def acts(spark, sf):
    return graph(spark, sf).where("kind NOT IN ('root', 'quote', 'reply')")


from tidegauge.catalog.sqlkit import r1 as R1  # noqa: E402
_COUNTS = """counts AS (SELECT root, count(*) FILTER (WHERE kind = 'like') AS likes, count(*) FILTER (WHERE kind = 'repost') AS reposts,
  count(*) FILTER (WHERE kind = 'reply') AS replies, count(*) FILTER (WHERE kind = 'quote') AS quotes FROM g GROUP BY 1)"""


@query("observed_post_counts", f"WITH {G}, {_COUNTS} SELECT * FROM counts")
def _(spark, sf):
    return en.observed_counts(graph(spark, sf), "root")


@query(
    "hydrated_posts",
    f"""WITH {G}, {_COUNTS} SELECT o_orderkey AS root, o_custkey AS actor, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS handle, CAST(floor(c_acctbal) AS BIGINT) AS followers,
    coalesce(likes, 0) AS likes, coalesce(reposts, 0) AS reposts, coalesce(replies, 0) AS replies, coalesce(quotes, 0) AS quotes,
    greatest(1, coalesce(likes, 0) + coalesce(reposts, 0) * 3 + coalesce(quotes, 0) * 4 + coalesce(replies, 0) * 4) AS score,
    {r6('round(5 + least(16, (coalesce(reposts, 0) + coalesce(quotes, 0)) * 1.8::DOUBLE) + least(14, coalesce(replies, 0) * 1.4::DOUBLE) + least(10, coalesce(likes, 0) * 0.18::DOUBLE), 1)')} AS priority
    FROM orders LEFT JOIN counts ON root = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey""",
)
def _(spark, sf):
    orders = st.table(spark, sf, "orders").select(F.col("o_orderkey").alias("root"), F.col("o_custkey").alias("actor"))
    # orders as posts, customers as profiles
    profiles = st.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("actor"), F.col("c_name").alias("handle"), F.floor("c_acctbal").alias("followers"))
    return en.hydrate(orders, en.observed_counts(graph(spark, sf), "root"), profiles, "root", "actor")


@query(
    "actor_activity",
    f"""WITH {G}, u AS (SELECT actor, ts, 0 AS is_i, root, 0.0::DOUBLE AS w, 1 AS n FROM p UNION ALL
      SELECT actor, ts, 1, root, CASE kind WHEN 'like' THEN 1.0 WHEN 'repost' THEN 3.0 ELSE 0.5 END::DOUBLE, 0 FROM i)
    SELECT actor, {big('sum(n)')} AS post_count, {r6('round(sum(w), 1)')} AS amplification, {ts('max(ts)')} AS last_activity,
      arg_max(root, {{'a': is_i, 'b': ts, 'c': root}}) AS last_target FROM u GROUP BY 1""",
)
def _(spark, sf):
    return en.actor_activity(posts(spark, sf), acts(spark, sf), "actor", "root", "ts")


# every event is a snapshot of its subject with two counters
_SNAPS = f"{st.ACTIONS_SQL}, snaps AS (SELECT event_id, k AS item, ts, user_id AS actor, CAST(floor(value * 10) AS BIGINT) AS likes, user_id AS replies, CAST(floor(value) AS BIGINT) % 7 AS reposts, event_id % 3 AS quotes FROM actions)"
_DELTAS = "deltas AS (SELECT *, " + ", ".join(
    f"greatest(0, {x} - coalesce(lag({x}) OVER w, 0)) AS delta_{x}" for x in ("likes", "replies", "reposts", "quotes")
) + ", coalesce(round((CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER w) / 60, 1), 0.0) AS delta_minutes FROM snaps WINDOW w AS (PARTITION BY item ORDER BY ts))"
_C = ["likes", "replies", "reposts", "quotes"]


def snaps(spark, sf):
    return st.actions(spark, sf).selectExpr(
        "event_id", "k AS item", "ts", "user_id AS actor", "CAST(floor(value * 10) AS BIGINT) AS likes", "user_id AS replies",
        "CAST(floor(value) AS BIGINT) % 7 AS reposts", "event_id % 3 AS quotes")


@query(
    "snapshot_deltas",
    f"WITH {_SNAPS}, {_DELTAS} SELECT event_id, item, {r6('delta_minutes')} AS delta_minutes, delta_likes, delta_replies, delta_reposts, delta_quotes FROM deltas",
)
def _(spark, sf):
    return en.snapshot_deltas(snaps(spark, sf), "item", "ts", _C).select("event_id", "item", "delta_minutes", *[f"delta_{x}" for x in _C])


@query(
    "snapshot_context",
    f"WITH {_SNAPS} SELECT item, count(*) AS snapshots, {ts('min(ts)')} AS first_at, {ts('max(ts)')} AS latest_at, arg_min(likes, ts) AS first_likes, arg_max(likes, ts) AS latest_likes FROM snaps GROUP BY 1",
)
def _(spark, sf):
    return en.snapshot_context(snaps(spark, sf), "item", "ts", ["likes"])


@query(
    "snapshots_keep_last",
    f"WITH {_SNAPS} SELECT item, event_id, {ts('ts')} AS ts FROM snaps QUALIFY row_number() OVER (PARTITION BY item ORDER BY ts DESC, event_id DESC) <= 12",
)
def _(spark, sf):
    return en.keep_last(snaps(spark, sf), "item", [F.col("ts").desc(), F.col("event_id").desc()], 12).select("item", "event_id", "ts")


_CASC = """rows_ AS (SELECT root, actor, ts, 1 AS w FROM p UNION ALL SELECT root, actor, ts, CASE kind WHEN 'repost' THEN 2 ELSE 1 END FROM i),
casc AS (SELECT root, sum(w)::BIGINT AS interactions, count(DISTINCT actor) AS participants, min(ts) AS first_seen, max(ts) AS last_seen FROM rows_ GROUP BY 1),
top_c AS (SELECT *, (SELECT sum(interactions) FROM casc) AS total FROM casc ORDER BY interactions DESC, participants DESC, root LIMIT 6)"""
_AMP = """arows AS (SELECT actor, CASE kind WHEN 'repost' THEN 3 ELSE 1 END AS w FROM i UNION ALL SELECT actor, CASE kind WHEN 'quote' THEN 5 ELSE 4 END FROM p WHERE kind <> 'root'),
amp AS (SELECT actor, sum(w)::BIGINT AS interactions, count(*) AS documents FROM arows GROUP BY 1),
top_a AS (SELECT *, (SELECT sum(interactions) FROM amp) AS total FROM amp ORDER BY interactions DESC, documents DESC, actor LIMIT 8)"""


@query(
    "cascade_leaders",
    f"""WITH {G}, {_CASC} SELECT root, interactions, participants, {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen,
    {r6(R1('interactions / total * 100'))} AS share_pct, {r6(R1('interactions / 168.0::DOUBLE'))} AS velocity FROM top_c""",
)
def _(spark, sf):
    return en.cascades(posts(spark, sf), acts(spark, sf), 168)


@query(
    "amplifier_leaders",
    f"WITH {G}, {_AMP} SELECT actor, interactions, documents, {r6(R1('interactions / total * 100'))} AS contribution_pct FROM top_a",
)
def _(spark, sf):
    return en.amplifiers(posts(spark, sf), acts(spark, sf))


@query(
    "amplifier_cascade_edges",
    f"""WITH {G}, {_CASC}, {_AMP} SELECT actor, root, {big("sum(CASE kind WHEN 'repost' THEN 2 ELSE 1 END)")} AS edge_weight FROM i
    WHERE root IN (SELECT root FROM top_c) AND actor IN (SELECT actor FROM top_a) GROUP BY 1, 2 ORDER BY edge_weight DESC, actor, root LIMIT 18""",
)
def _(spark, sf):
    p, i = posts(spark, sf), acts(spark, sf)
    return en.amplifier_edges(i, en.cascades(p, i, 168), en.amplifiers(p, i))


_RATE = lambda k: R1(f"count(*) FILTER (WHERE kind = '{k}') / 43200.0::DOUBLE")


@query(
    "stream_overview",
    f"""WITH {G}, {_CASC}, u AS (SELECT 'post' AS kind, actor, ts, CASE kind WHEN 'root' THEN 4 ELSE 3 END AS w FROM p UNION ALL SELECT kind, actor, ts, CASE kind WHEN 'repost' THEN 2 ELSE 1 END FROM i),
    s AS (SELECT *, least(23, floor((CAST(floor(epoch(ts)) AS BIGINT) - epoch(TIMESTAMP '2023-12-31 12:00:00')) / 108000)) AS slot FROM u),
    o AS (SELECT count(DISTINCT actor) AS account_spread, count(*) FILTER (WHERE kind = 'post') AS posts, {_RATE('post')} AS ppm, {_RATE('like')} AS lpm, {_RATE('repost')} AS rpm,
      {_RATE('reply')} AS ypm, {_RATE('quote')} AS qpm, sum(CASE WHEN ts BETWEEN TIMESTAMP '2023-12-31 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00' AND slot >= 18 THEN w ELSE 0 END) AS rec,
      sum(CASE WHEN ts BETWEEN TIMESTAMP '2023-12-31 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00' AND slot >= 12 AND slot < 18 THEN w ELSE 0 END) AS pri FROM s),
    n AS (SELECT {R1("sum(CASE WHEN participants < 3 AND interactions < 10 THEN interactions ELSE 0 END) / sum(interactions) * 100")} AS noise FROM top_c),
    e AS (SELECT *, {R1('posts * 4 + lpm * 2 + rpm * 16 + ypm * 18 + qpm * 20')} AS inten FROM o, n)
    SELECT account_spread, posts, {r6('ppm')} AS posts_per_minute, {r6('lpm')} AS likes_per_minute, {r6('rpm')} AS reposts_per_minute, {r6('ypm')} AS replies_per_minute,
      {r6('qpm')} AS quotes_per_minute, {r6('noise')} AS noise_ratio_pct, {r6('inten')} AS engagement_intensity,
      {r6(R1('inten * greatest(1, log2(account_spread + 1)) * greatest(0.25, 1 - noise / 100)'))} AS meaningful_attention,
      {r6('CASE WHEN pri > 0 THEN ' + R1('(rec - pri) / pri * 100') + ' WHEN rec > 0 THEN 100 ELSE 0 END')} AS acceleration FROM e""",
)
def _(spark, sf):
    return en.stream_overview(posts(spark, sf), acts(spark, sf), st.as_of_lit(), 43200)


@query(
    "platform_breakdown",
    f"""WITH {st.ACTIONS_SQL}, a AS (SELECT k, event_type, sum(greatest(0, value)) AS v FROM actions GROUP BY 1, 2)
    SELECT k, event_type, {r6('v')} AS interactions, {r6(R1('v / sum(v) OVER (PARTITION BY k) * 100'))} AS share_pct FROM a""",
)
def _(spark, sf):
    return en.platform_breakdown(st.actions(spark, sf), "k", "event_type", "value")


@query(
    "group_concentration",
    f"""WITH {st.ACTIONS_SQL}, a AS (SELECT event_type AS grp, k, count(*) AS n FROM actions GROUP BY 1, 2), b AS (SELECT event_type AS grp, user_id, count(*) AS n FROM actions GROUP BY 1, 2)
    SELECT grp AS event_type, d AS documents, roots, authors, {r6('m / d')} AS top_root_share, {r6('am / d')} AS single_author_share FROM
    (SELECT grp, {big('sum(n)')} AS d, max(n) AS m, count(*) AS roots FROM a GROUP BY 1) JOIN (SELECT grp, max(n) AS am, count(*) AS authors FROM b GROUP BY 1) USING (grp)""",
)
def _(spark, sf):
    return en.concentration(st.actions(spark, sf), "event_type", "k", "user_id")


# platform of a document: live, video, feed or forum
_PLAT = "CASE event_type WHEN 'view' THEN 'bluesky' WHEN 'click' THEN 'youtube' WHEN 'error' THEN 'news' ELSE 'reddit' END"
_AGE = "CAST(greatest(0, floor((1706616000 - floor(epoch(ts))) / 60 + 0.5)) AS BIGINT)"
_FRESH_SQL = """CASE plat WHEN 'bluesky' THEN CASE WHEN age <= 20 THEN 100 WHEN age <= 60 THEN 86 WHEN age <= 180 THEN 66 WHEN age <= 720 THEN 40 ELSE 16 END
 WHEN 'youtube' THEN CASE WHEN age <= 120 THEN 100 WHEN age <= 360 THEN 84 WHEN age <= 1440 THEN 58 WHEN age <= 2880 THEN 34 ELSE 16 END
 WHEN 'news' THEN CASE WHEN age <= 60 THEN 100 WHEN age <= 240 THEN 82 WHEN age <= 720 THEN 58 WHEN age <= 1440 THEN 34 ELSE 14 END
 ELSE CASE WHEN age <= 60 THEN 100 WHEN age <= 360 THEN 80 WHEN age <= 1440 THEN 56 WHEN age <= 2880 THEN 34 ELSE 14 END END"""
_FDOCS = f"{st.ACTIONS_SQL}, fdocs AS (SELECT *, {_FRESH_SQL} AS fresh FROM (SELECT *, {_PLAT} AS plat, {_AGE} AS age FROM actions))"


def fresh_docs(spark, sf):
    age = F.greatest(F.lit(0), F.floor((F.lit(1706616000) - F.unix_timestamp("ts")) / 60 + 0.5))
    df = st.actions(spark, sf).withColumn("plat", F.expr(_PLAT)).withColumn("age", age)
    return df.withColumn("fresh", sc.platform_freshness("plat", "age"))


_STATE = lambda s: f"CASE WHEN {s} >= 78 THEN 'fresh' WHEN {s} >= 58 THEN 'delayed' WHEN {s} >= 38 THEN 'mixed' ELSE 'stale' END"


@query(
    "document_freshness",
    f"WITH {_FDOCS} SELECT event_id, plat, age, {r6('fresh')} AS score, {_STATE('fresh')} AS state, CASE WHEN age <= 12 THEN 'fresh' WHEN age <= 30 THEN 'mixed' WHEN age <= 90 THEN 'delayed' ELSE 'stale' END AS age_state FROM fdocs",
)
def _(spark, sf):
    return fresh_docs(spark, sf).select(
        "event_id", "plat", "age", F.col("fresh").alias("score"), sc.freshness_state("fresh").alias("state"), sc.age_state("age").alias("age_state"))


@query(
    "group_freshness",
    f"""WITH {_FDOCS}, a AS (SELECT k, plat, {R1('sum(fresh * (1 + least(2.8, log10(greatest(value, 0) + 1)))) / greatest(sum(1 + least(2.8, log10(greatest(value, 0) + 1))), 1)')} AS s FROM fdocs GROUP BY 1, 2),
    b AS (SELECT k, {R1('avg(s)')} AS score, count(*) FILTER (WHERE s >= 55) AS confirmed_spread, max(s < 42) AND max(s >= 68) AS mixed FROM a GROUP BY 1)
    SELECT k, {r6('score')} AS score, confirmed_spread, CASE WHEN mixed THEN 'mixed' ELSE {_STATE('score')} END AS state FROM b""",
)
def _(spark, sf):
    return en.group_freshness(fresh_docs(spark, sf), "k", "plat", "fresh", "value")


@query(
    "group_unique_interactions",
    f"WITH {st.ACTIONS_SQL} SELECT event_type, {r6('sum(v)')} AS interactions FROM (SELECT event_type, k, max(value) AS v FROM actions GROUP BY 1, 2) GROUP BY 1",
)
def _(spark, sf):
    return en.unique_interactions(st.actions(spark, sf), "event_type", "k", "value")


_VEL = lambda x: R1(f"sum(delta_{x}) / greatest(sum(greatest(delta_minutes / 60, 0.25)), 0.25)")


@query(
    "group_velocity",
    f"""WITH {_SNAPS}, {_DELTAS}, v AS (SELECT item, {_VEL('quotes')} AS q, {_VEL('reposts')} AS r, {_VEL('replies')} AS y, {_VEL('likes')} AS l, count(DISTINCT actor) AS authors FROM deltas GROUP BY 1)
    SELECT item, {r6('q')} AS quote_velocity, {r6('r')} AS repost_velocity, {r6('y')} AS reply_velocity, {r6('l')} AS like_velocity, authors,
    CASE WHEN q >= r AND q >= y AND q > 0 THEN 'Quote burst' WHEN r >= y AND r > 0 THEN 'Repost cascade' WHEN y > 0 THEN 'Reply surge' WHEN authors >= 6 THEN 'Cross-account spread' ELSE 'Steady attention' END AS leading_signal FROM v""",
)
def _(spark, sf):
    deltas = en.snapshot_deltas(snaps(spark, sf), "item", "ts", _C)
    return en.group_velocity(deltas, "item", "delta_minutes", {"quote": "delta_quotes", "repost": "delta_reposts", "reply": "delta_replies", "like": "delta_likes"})


_LOG10 = lambda x, f, cap: f"least({cap}::DOUBLE, log10(greatest({x}, 0) + 1) * {f}::DOUBLE)"
_LOG2 = lambda x, f, cap: f"least({cap}::DOUBLE, log2(greatest({x}, 0) + 1) * {f}::DOUBLE)"
_WI = lambda p, r, m, l: R1(f"{R1(f'{p} * 14')} + {R1(_LOG2(r, 7, 18))} + {R1(_LOG2(m, 3, 12))} + {R1(_LOG10(l, 1, 6))}")
_PH = lambda x: f"greatest({x} / greatest(delta_minutes / 60, 0.25), 0)"


@query(
    "interaction_scores",
    f"""WITH {_SNAPS}, {_DELTAS} SELECT event_id, {r6(_WI('1', 'reposts + quotes', 'replies', 'likes'))} AS weighted, {r6(R1(f"14 + {R1(_LOG2('reposts', 7, 18))}"))} AS narrative,
    {r6(R1(f"6 + {_LOG10('likes', 4.5, 20)} + {_LOG10('replies', 6, 22)} + {_LOG10('event_id', 1.5, 9)}"))} AS video,
    {r6(R1(f"{_LOG10(_PH('delta_likes'), 4, 18)} + {_LOG10(_PH('delta_replies'), 5.5, 20)} + {_LOG10(_PH('delta_quotes'), 8, 24)}"))} AS video_delta,
    {r6(R1(f"{_WI('0', '0', '1', 'likes')} + {_LOG2('replies', 2.4, 8)}"))} AS comment,
    {r6(R1(f"{_WI('1', 'reposts + quotes', 'replies', 'likes')} + {_LOG10('actor', 2.1, 10)} + CASE event_id % 3 WHEN 0 THEN 4.2 WHEN 1 THEN 2.4 ELSE 0 END::DOUBLE"))} AS post,
    {r6(R1(f"{_LOG10(_PH('(delta_reposts + delta_quotes)'), 11, 24)} + {_LOG10(_PH('delta_replies'), 9, 18)} + {_LOG10(_PH('delta_likes'), 5, 12)}"))} AS snapshot,
    {r6(R1(f"CASE event_id % 4 WHEN 0 THEN {_WI('0', '0', '1', '0')} WHEN 1 THEN {_WI('0', '0', '1', '0')} WHEN 2 THEN {_WI('0', '1', '0', '0')} ELSE {_WI('0', '0', '0', '1')} END + {_LOG10('actor', 1.8, 7)} + CASE event_id % 4 WHEN 0 THEN 2.5 ELSE 0 END::DOUBLE + {_LOG10('likes', 2.5, 8)}"))} AS interaction
    FROM deltas""",
)
def _(spark, sf):
    d = en.snapshot_deltas(snaps(spark, sf), "item", "ts", _C)
    kind = F.expr("CASE event_id % 3 WHEN 0 THEN 'quote' WHEN 1 THEN 'reply' ELSE 'root' END")
    act = F.expr("CASE event_id % 4 WHEN 0 THEN 'quote' WHEN 1 THEN 'reply' WHEN 2 THEN 'repost' ELSE 'like' END")
    return d.select(
        "event_id", sc.weighted_interactions(F.lit(1), F.col("reposts") + F.col("quotes"), "replies", "likes").alias("weighted"),
        sc.narrative_interactions(F.lit(1), "reposts").alias("narrative"), sc.video_score("likes", "replies", "event_id").alias("video"),
        sc.video_delta_score("delta_likes", "delta_replies", "delta_quotes", "delta_minutes").alias("video_delta"),
        sc.comment_score("likes", "replies").alias("comment"),
        sc.post_score(F.lit(1), F.col("reposts") + F.col("quotes"), "replies", "likes", "actor", kind).alias("post"),
        sc.snapshot_score("delta_reposts", "delta_quotes", "delta_replies", "delta_likes", "delta_minutes").alias("snapshot"),
        sc.interaction_event_score(act, "actor", "likes").alias("interaction"),
    )


@query(
    "author_merge",
    f"""WITH e AS (SELECT user_id, ts, CASE WHEN event_id % 4 = 0 THEN event_type END AS handle, CASE WHEN event_id % 3 = 0 THEN event_id END AS followers FROM events)
    SELECT user_id, arg_max(handle, ts) FILTER (WHERE handle IS NOT NULL) AS handle, arg_max(followers, ts) FILTER (WHERE followers IS NOT NULL) AS followers,
    {ts('min(ts)')} AS first_seen_at, {ts('max(ts)')} AS last_seen_at FROM e GROUP BY 1""",
)
def _(spark, sf):
    df = st.table(spark, sf, "events").selectExpr(
        "user_id", "ts", "IF(event_id % 4 = 0, event_type, NULL) AS handle", "IF(event_id % 3 = 0, event_id, NULL) AS followers")
    return en.author_merge(df, "user_id", "ts", "ts", "ts", ["handle", "followers"])


@query(
    "upsert_merge",
    """WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS first_seen FROM orders WHERE o_orderkey % 3 <> 0),
    n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'X' END AS status, o_totalprice * 2 AS price, o_orderdate + INTERVAL 1 DAY AS first_seen FROM orders WHERE o_orderkey % 2 = 0)
    SELECT coalesce(s.id, n.id) AS id, coalesce(n.status, s.status) AS status, """ + r6("coalesce(n.price, s.price)") + """ AS price, """ + ts("coalesce(s.first_seen, n.first_seen)") + """ AS first_seen,
    CASE WHEN n.id IS NULL THEN 0 ELSE 1 END::BIGINT AS touched FROM s FULL JOIN n ON s.id = n.id""",
)
def _(spark, sf):
    o = st.table(spark, sf, "orders")
    s = o.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_totalprice AS price", "o_orderdate AS first_seen")
    n = o.where("o_orderkey % 2 = 0").selectExpr(
        "o_orderkey AS id", "IF(o_orderkey % 5 = 0, NULL, 'X') AS status", "o_totalprice * 2 AS price", "o_orderdate + INTERVAL 1 DAY AS first_seen")
    return en.upsert(s, n, ["id"], "first_seen", ["status", "price"])
