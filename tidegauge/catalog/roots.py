"""Root posts: events as posts that answer each other, and as interactions with them."""

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import big, r6, ts
from tidegauge.operators import roots as ro
from tidegauge.plans import standins as st

# chains of up to a thousand posts, side branches, parents that are no post (negative), and a few loops
_PARENT = "CASE WHEN event_id % 1000 = 0 THEN NULL WHEN event_id % 1000 = 7 THEN -event_id WHEN event_id % 500 = 301 THEN event_id + 2 WHEN event_id % 11 = 0 THEN event_id - event_id % 1000 ELSE event_id - 1 END"
_POSTS = ["event_id AS post", f"{_PARENT} AS parent", "user_id AS actor", "ts", "concat('Post ', event_id) AS text", "concat('tag', k % 5) AS tag", "concat('entity ', user_id % 4) AS entity",
          "CASE WHEN event_id % 3 = 0 THEN concat('entity ', user_id % 4) ELSE concat('phrase ', event_id % 3) END AS phrase", "CASE WHEN event_id % 7 = 0 THEN concat('site', k % 3) END AS url"]
_ACTS = ["event_id - event_id % 4 AS post", "user_id AS actor", "ts"]

_ROOTS = f"""{st.ACTIONS_SQL}, posts AS MATERIALIZED (SELECT {', '.join(_POSTS)} FROM actions), acts AS (SELECT {', '.join(_ACTS)} FROM actions),
up AS MATERIALIZED (SELECT post AS x, parent AS p FROM posts WHERE parent IS NOT NULL),
walk(x, root) AS (SELECT post, post FROM posts WHERE parent IS NULL UNION ALL SELECT x, p FROM up WHERE p NOT IN (SELECT post FROM posts) UNION ALL SELECT up.x, walk.root FROM walk JOIN up ON up.p = walk.x),
found AS MATERIALIZED (SELECT post, root FROM posts LEFT JOIN walk ON x = post)"""
_CONS = f"""{_ROOTS}, rooted AS (SELECT posts.*, root FROM posts JOIN found USING (post)),
al AS (SELECT root, actor AS who, ts AS moment, 1 AS post FROM rooted WHERE root IS NOT NULL UNION ALL SELECT coalesce(root, acts.post), acts.actor, acts.ts, 0 FROM acts LEFT JOIN found ON found.post = acts.post),
cons AS MATERIALIZED (SELECT root, CAST(sum(post) AS BIGINT) AS posts, count(*) FILTER (WHERE post = 0) AS interactions, count(*) FILTER (WHERE post = 0 AND moment >= TIMESTAMP '{st.AS_OF}' - INTERVAL 24 HOUR) AS recent_interactions,
  count(DISTINCT who) AS authors, min(moment) AS first_seen, max(moment) AS last_seen FROM al WHERE root IS NOT NULL GROUP BY 1)"""
_CAND = """tags AS (SELECT root, kind, key, count(*) AS support FROM (SELECT DISTINCT root, post, 'hashtag' AS kind, tag AS key FROM rooted UNION SELECT root, post, 'entity', entity FROM rooted UNION SELECT root, post, 'phrase', phrase FROM rooted
  UNION SELECT root, post, 'url', url FROM rooted WHERE url IS NOT NULL) WHERE root IS NOT NULL GROUP BY 1, 2, 3),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, kind ORDER BY support DESC, key) AS place FROM tags) WHERE place <= CASE kind WHEN 'entity' THEN 3 WHEN 'phrase' THEN 3 ELSE 2 END),
cand AS (SELECT root, kind, key, support, CASE kind WHEN 'entity' THEN 360 WHEN 'phrase' THEN 300 WHEN 'hashtag' THEN 240 ELSE 140 END AS priority FROM kept
  UNION ALL SELECT e.root, 'hybrid', e.key || '__' || p.key, least(e.support, p.support), 460 FROM kept e JOIN kept p ON e.root = p.root WHERE e.kind = 'entity' AND p.kind = 'phrase' AND e.place = 1 AND p.place = 1 AND e.key <> p.key)"""


def rooted(spark, sf):
    posts = st.actions(spark, sf).selectExpr(*_POSTS)
    return posts.join(ro.find_roots(posts, "post", "parent"), "post")


def acts(spark, sf):
    return st.actions(spark, sf).selectExpr(*_ACTS)


def consolidated(posts, actions):
    return ro.consolidate(posts, actions, "post", "post", "actor", "ts", st.as_of_lit())


def signal_keys(posts):
    return ro.candidate_keys(posts, {kind: F.array(kind if kind != "hashtag" else "tag") for kind in ("url", "entity", "phrase", "hashtag")})


@query("reply_roots", f"WITH RECURSIVE {_ROOTS} SELECT post, root FROM found")
def _(spark, sf):
    return ro.find_roots(st.actions(spark, sf).selectExpr(*_POSTS), "post", "parent")


@query(
    "root_consolidation",
    f"""WITH RECURSIVE {_CONS}, e AS (SELECT root, arg_min({{'a': actor, 't': text}}, {{'ts': ts, 'p': post}}) AS x FROM rooted WHERE root IS NOT NULL GROUP BY 1)
    SELECT root, posts, interactions, recent_interactions, authors, {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen, x.a AS primary_author, x.t AS root_text FROM cons LEFT JOIN e USING (root)""",
)
def _(spark, sf):
    return consolidated(rooted(spark, sf), acts(spark, sf))


@query("root_topic_keys", f"WITH RECURSIVE {_CONS}, {_CAND} SELECT root, kind, key, support, {big('priority')} AS priority FROM cand")
def _(spark, sf):
    return signal_keys(rooted(spark, sf))


@query(
    "root_group_seeds",
    f"""WITH RECURSIVE {_CONS}, {_CAND}, b AS (SELECT root, kind || ':' || key AS grp FROM cand QUALIFY row_number() OVER (PARTITION BY root ORDER BY priority DESC, support DESC, key) = 1),
    gr AS (SELECT cons.*, coalesce(grp, 'root:' || cons.root) AS grp FROM cons LEFT JOIN b USING (root)),
    w AS (SELECT root, count(*) FILTER (WHERE moment > TIMESTAMP '{st.AS_OF}' - INTERVAL 24 HOUR) AS current, count(*) FILTER (WHERE moment <= TIMESTAMP '{st.AS_OF}' - INTERVAL 24 HOUR) AS prior FROM al
      WHERE post = 0 AND moment >= TIMESTAMP '{st.AS_OF}' - INTERVAL 48 HOUR AND moment <= TIMESTAMP '{st.AS_OF}' GROUP BY 1),
    s AS (SELECT grp, count(*) AS roots, sum(posts) AS posts, sum(interactions) AS interactions, sum(authors) AS authors, max(interactions) AS top, coalesce(sum(current), 0) AS current, coalesce(sum(prior), 0) AS prior, min(first_seen) AS f
      FROM gr LEFT JOIN w USING (root) GROUP BY 1),
    m AS (SELECT *, greatest(1, CAST(round(epoch(TIMESTAMP '{st.AS_OF}' - f) / 60) AS BIGINT)) AS minutes FROM s)
    SELECT grp AS "group", roots, {big('posts')} AS posts, {big('interactions')} AS interactions, {big('authors')} AS authors, {big('current')} AS current, {big('prior')} AS prior, {r6('top / greatest(interactions, 1)')} AS concentration,
      minutes AS first_seen_minutes, {big('CASE WHEN minutes <= 60 THEN 100 WHEN minutes <= 360 THEN 88 WHEN minutes <= 720 THEN 72 WHEN minutes <= 1440 THEN 54 WHEN minutes <= 2880 THEN 34 ELSE 16 END')} AS recency,
      (authors >= 2 AND roots >= 2) OR posts >= 3 OR interactions >= 8 AS has_support FROM m""",
)
def _(spark, sf):
    posts, actions = rooted(spark, sf), acts(spark, sf)
    found = consolidated(posts, actions)
    groups = ro.root_groups(found, signal_keys(posts))
    activity = actions.join(posts.select("post", "root"), "post", "left").select(F.coalesce("root", "post").alias("root"), "ts")
    seeds = ro.group_seeds(found, groups, activity, "ts", st.as_of_lit())
    return seeds.select("group", "roots", "posts", "interactions", "authors", "current", "prior", "concentration", "first_seen_minutes", "recency", "has_support")
