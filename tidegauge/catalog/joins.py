"""Normalisation, retention, scoping, unions, coverage."""

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import big, r1, r6, ts
from tidegauge.catalog.texts import _TOK
from tidegauge.functions import text as tx
from tidegauge.operators import posts as po
from tidegauge.plans import standins as st

_A = "TIMESTAMP '2024-01-30 12:00:00'"

_TIMES = """event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN ts + INTERVAL {h} ELSE ts END AS created, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL {m} END AS indexed, ts + INTERVAL {m2} AS ingested, event_id % 400 AS post"""


@query(
    "normalised_times",
    f"""WITH t AS (SELECT {_TIMES.format(h='1 HOUR', m='1 MINUTE', m2='2 MINUTE')} FROM events), s AS (SELECT *, CASE WHEN coalesce(created, indexed, ingested) > ingested + INTERVAL 5 MINUTE THEN CASE WHEN indexed <= ingested + INTERVAL 5 MINUTE THEN indexed ELSE ingested END ELSE coalesce(created, indexed, ingested) END AS created_at FROM t)
    SELECT post, event_id, {ts('created_at')} AS created_at FROM s QUALIFY row_number() OVER (PARTITION BY post ORDER BY event_id DESC) = 1""",
)
def _(spark, sf):
    df = st.table(spark, sf, "events").selectExpr(*[
        "event_id", "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS created",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 1 MINUTE END AS indexed", "ts + INTERVAL 2 MINUTES AS ingested", "event_id % 400 AS post"])
    return po.last_wins(po.settle_times(df, "created", "indexed", "ingested"), ["post"], "event_id").select("post", "event_id", "created_at")


_PAY = """concat('{"kind":"commit","did":"d', user_id, '","time_us":', 1700000000000000 + event_id * 1000000, ',"commit":{"operation":"create","collection":"', CASE event_type WHEN 'signup' THEN 'like' WHEN 'click' THEN 'repost' ELSE 'post' END, '","rkey":"', event_id, '","record":{"text":" hi   there ",',
 CASE event_type WHEN 'error' THEN concat('"reply":{"parent":"p', k, '"}') WHEN 'purchase' THEN concat('"quote":"q', k, '"') WHEN 'view' THEN '"createdAt":"x"' ELSE concat('"subject":"s', k, '"') END, '}}}')"""


@query(
    "event_posts_and_edges",
    f"""WITH {st.ACTIONS_SQL} SELECT CASE event_type WHEN 'signup' THEN 'like' WHEN 'click' THEN 'repost' WHEN 'error' THEN 'reply' ELSE 'quote' END || ':d' || user_id || ':' || CASE event_type WHEN 'error' THEN 'p' WHEN 'purchase' THEN 'q' ELSE 's' END || k AS id, count(*) AS n
    FROM actions WHERE event_type <> 'view' GROUP BY 1""",
)
def _(spark, sf):
    ev = po.parse_events(st.actions(spark, sf).selectExpr(f"{_PAY} AS payload"), "payload")
    return po.event_interactions(ev, po.event_posts(ev)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "event_post_rows",
    f"""WITH {st.ACTIONS_SQL} SELECT 'at://d' || user_id || '/post/' || event_id AS uri, CASE event_type WHEN 'error' THEN 'reply' WHEN 'purchase' THEN 'quote' ELSE 'root' END AS post_type, 'hi there' AS text,
    CASE WHEN event_type = 'error' THEN 'p' || k ELSE 'at://d' || user_id || '/post/' || event_id END AS root FROM actions WHERE event_type IN ('view','error','purchase')""",
)
def _(spark, sf):
    ev = po.parse_events(st.actions(spark, sf).selectExpr(f"{_PAY} AS payload"), "payload")
    return po.event_posts(ev).select("uri", "post_type", "text", "root")


@query(
    "window_prune",
    "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= TIMESTAMP '2000-01-01' - INTERVAL 8760 HOUR AND o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 8760 HOUR",
)
def _(spark, sf):
    kids = st.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return po.window_prune(st.table(spark, sf, "orders"), kids, "o_orderkey", "l_orderkey", "o_orderdate", "l_shipdate", st.as_of_lit("2000-01-01 00:00:00"), 8760)[1].select("l_orderkey", "l_linenumber")


@query("retain_recent_or_active", f"SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(spark, sf):
    act = st.table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return po.retain(st.table(spark, sf, "orders"), "o_orderkey", "o_orderdate", st.as_of_lit("2000-01-01 00:00:00"), act).select("o_orderkey")


@query(
    "scope_lookback",
    f"WITH {st.ACTIONS_SQL}, c AS (SELECT DISTINCT k FROM actions WHERE event_type <> 'view' AND ts >= {_A} - INTERVAL 6 HOUR) SELECT event_id FROM actions WHERE event_type = 'view' AND (ts >= {_A} - INTERVAL 12 HOUR OR k IN (SELECT k FROM c))",
)
def _(spark, sf):
    a = st.actions(spark, sf)
    return po.scope_lookback(a.where("event_type = 'view'"), a.where("event_type <> 'view'"), "k", "ts", st.as_of_lit(), 21600).select("event_id")


@query("prune_counts", f"SELECT count(*) FILTER (WHERE ts < {_A} - INTERVAL 168 HOUR) AS deleted, count(*) FILTER (WHERE ts >= {_A} - INTERVAL 168 HOUR) AS kept FROM events")
def _(spark, sf):
    return po.prune_count(st.table(spark, sf, "events"), "ts", st.as_of_lit("2024-01-23 12:00:00"))


@query(
    "document_union",
    "SELECT 'post' AS kind, CAST(doc_id AS VARCHAR) AS id, lang, NULL AS role, NULL AS domain FROM documents UNION ALL SELECT 'turn', conv_id || ':' || turn, NULL, role, NULL FROM conversations UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), NULL, NULL, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)",
)
def _(spark, sf):
    pages = st.table(spark, sf, "pages").selectExpr("CAST(page_id AS STRING) AS id", "url")
    native = st.table(spark, sf, "labels").selectExpr("CAST(doc_id AS STRING) AS id")
    return po.unite({
        "post": st.table(spark, sf, "documents").selectExpr("CAST(doc_id AS STRING) AS id", "lang"),
        "turn": st.table(spark, sf, "conversations").selectExpr("concat(conv_id, ':', turn) AS id", "role"),
        "page": po.drop_known(pages, native, "id").select("id", tx.domain("url").alias("domain")),
    }).select("kind", "id", "lang", "role", "domain")


@query(
    "source_health",
    f"""WITH s AS (SELECT user_id AS source, max(ts) AS l, CAST(user_id % 6 AS BIGINT) AS f FROM events GROUP BY 1), a AS (SELECT source, f, round((CAST(epoch({_A}) AS BIGINT) - CAST(floor(epoch(l)) AS BIGINT)) / 60, 1) AS age FROM s)
    SELECT source, {r6('age')} AS age_minutes, CASE WHEN age <= 60 AND f = 0 THEN 'healthy' WHEN age <= 360 AND f <= 1 THEN 'delayed' WHEN age <= 1440 THEN 'degraded' ELSE 'stale' END AS status,
    {big('greatest(0, CASE WHEN age <= 60 AND f = 0 THEN 100 WHEN age <= 360 AND f <= 1 THEN 82 WHEN age <= 1440 THEN 58 ELSE 24 END - least(f, 4) * 8)')} AS score FROM a""",
)
def _(spark, sf):
    return _health(spark, sf).select("source", "age_minutes", "status", "score")


def _health(spark, sf):
    s = st.table(spark, sf, "events").groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("l")).withColumn("f", F.col("source") % 6)
    return po.source_health(s, st.as_of_lit(), "l", "f")


@query(
    "health_summary",
    f"""WITH s AS (SELECT user_id AS source, max(ts) AS l, user_id % 6 AS f FROM events GROUP BY 1), a AS (SELECT *, round((CAST(epoch({_A}) AS BIGINT) - CAST(floor(epoch(l)) AS BIGINT)) / 60, 1) AS age FROM s),
    b AS (SELECT *, greatest(0, CASE WHEN age <= 60 AND f = 0 THEN 100 WHEN age <= 360 AND f <= 1 THEN 82 WHEN age <= 1440 THEN 58 ELSE 24 END - least(f, 4) * 8) AS sc FROM a),
    c AS (SELECT count(*) AS sources, {r1('count(*) FILTER (WHERE age <= 60) / count(*) * 100')} AS r1h, {r1('count(*) FILTER (WHERE age <= 360) / count(*) * 100')} AS r6h, {r1('count(*) FILTER (WHERE age <= 1440) / count(*) * 100')} AS cov, {r1('avg(age)')} AS aa, {r1('sum(sc) / count(*)')} AS fs,
      {r1('count(*) FILTER (WHERE source % 2 = 0) / count(*) * 100')} AS cp, {r1('count(*) FILTER (WHERE source % 3 = 0) / count(*) * 100')} AS op FROM b)
    SELECT sources, {r6('r1h')} AS refreshed_1h_pct, {r6('r6h')} AS refreshed_6h_pct, {r6('cov')} AS coverage_score, {r6('aa')} AS average_age, {r6('fs')} AS freshness_score, {r6('cp')} AS covered_pct, {r6('op')} AS complete_pct, {r6('least(100, ' + r1('op * 0.7::DOUBLE + cp * 0.3::DOUBLE') + ')')} AS completeness FROM c""",
)
def _(spark, sf):
    return po.health_summary(_health(spark, sf), F.col("source") % 2 == 0, F.col("source") % 3 == 0)


@query("run_success_rate", f"SELECT {r6(r1('''avg(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0 END) * 100'''))} AS success_rate FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)")
def _(spark, sf):
    o = st.table(spark, sf, "orders").withColumn("s", F.expr("CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'partial' ELSE 'failed' END"))
    return po.success_rate(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], "s")


@query("value_breakdown", "SELECT 'c_mktsegment' AS dimension, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 2")
def _(spark, sf):
    return po.breakdown(st.table(spark, sf, "customer"), "c_mktsegment", "c_nationkey")


@query("freshness_probe", f"SELECT 'events' AS \"table\", {ts('max(ts)')} AS latest, count(*) AS rows FROM events UNION ALL SELECT 'orders', {ts('max(o_orderdate)')}, count(*) FROM orders UNION ALL SELECT 'lineitem', {ts('max(l_shipdate)')}, count(*) FROM lineitem")
def _(spark, sf):
    return po.freshness_probe({"events": (st.table(spark, sf, "events"), "ts"), "orders": (st.table(spark, sf, "orders"), "o_orderdate"), "lineitem": (st.table(spark, sf, "lineitem"), "l_shipdate")})


@query("search_interest", "SELECT p_brand, CAST(max(p_size) AS BIGINT) AS score, arg_max(p_name, {'a': p_size, 'b': p_name}) AS strongest, count(DISTINCT trim(p_name)) AS queries FROM part GROUP BY 1")
def _(spark, sf):
    return po.strongest(st.table(spark, sf, "part"), "p_brand", "p_size", "p_name")


@query(
    "title_coverage",
    "WITH l AS (SELECT o_custkey, arg_max(CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'pending' ELSE 'failed' END, {'d': o_orderdate, 'k': o_orderkey}) AS s FROM orders GROUP BY 1) SELECT count(*) AS topics, count(*) FILTER (WHERE s = 'ready') AS ready, count(*) FILTER (WHERE s = 'pending') AS pending, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s IS NULL) AS missing FROM customer LEFT JOIN l ON o_custkey = c_custkey",
)
def _(spark, sf):
    o = st.table(spark, sf, "orders").selectExpr("o_custkey AS c_custkey", "struct(o_orderdate, o_orderkey) AS at", "CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'pending' ELSE 'failed' END AS s0")
    return po.latest_state_coverage(st.table(spark, sf, "customer"), o, "c_custkey", "at", "s0")


@query("rotation_coverage", f"SELECT sources, due, complete, {r6(r1('complete / sources * 100'))} AS complete_pct, CASE WHEN complete = sources THEN 'live' WHEN complete > 0 THEN 'backfill' ELSE 'empty' END AS phase FROM (SELECT count(*) AS sources, count(*) FILTER (WHERE s_acctbal < 3000) AS due, count(*) FILTER (WHERE s_acctbal >= 5000) AS complete FROM supplier)")
def _(spark, sf):
    return po.rotation_coverage(st.table(spark, sf, "supplier"), F.col("s_acctbal") < 3000, F.col("s_acctbal") >= 5000)


@query(
    "message_assignment",
    f"WITH m AS (SELECT l_partkey AS message, min(l_suppkey) AS trend FROM lineitem GROUP BY 1) SELECT trend, count(*) AS messages, {r6('sum(p_retailprice)')} AS engagement FROM m JOIN part ON p_partkey = message GROUP BY 1",
)
def _(spark, sf):
    claims = st.table(spark, sf, "lineitem").selectExpr("l_suppkey AS trend", "array(l_partkey) AS ids")
    msgs = st.table(spark, sf, "part").selectExpr("p_partkey AS message", "p_retailprice AS w")
    return po.first_trend_wins(claims, msgs, "trend", "ids", "message", "w")


@query(
    "comment_threads",
    "SELECT o_orderkey AS item, 'c' || o_orderkey AS id, NULL AS parent, o_custkey AS likes FROM orders UNION ALL SELECT o_orderkey, 'r' || o_orderkey, 'c' || o_orderkey, o_custkey % 5 FROM orders WHERE o_orderkey % 3 = 0",
)
def _(spark, sf):
    o = st.table(spark, sf, "orders").selectExpr("o_orderkey AS item", """concat('[{"id":"c', o_orderkey, '","likes":', o_custkey, ',"replies":[', IF(o_orderkey % 3 = 0, concat('{"id":"r', o_orderkey, '","likes":', o_custkey % 5, '}'), ''), ']}]') AS payload""")
    return po.flatten_thread(o, "payload", "array<struct<id: string, likes: long, replies: array<struct<id: string, likes: long>>>>", "item")


@query(
    "unique_slugs",
    "SELECT p_partkey, CASE WHEN n > 1 THEN b || '-' || n ELSE b END AS slug FROM (SELECT p_partkey, b, row_number() OVER (PARTITION BY b ORDER BY p_partkey) AS n FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS b FROM part))",
)
def _(spark, sf):
    return po.unique_slugs(st.table(spark, sf, "part"), "p_name", "p_partkey").select("p_partkey", "slug")


@query(
    "label_evidence_support",
    f"""WITH l AS (SELECT p_type AS topic, p_name, list_distinct(string_split(p_name || ' ' || p_brand, ' ')) AS w FROM part), lw AS (SELECT DISTINCT topic, unnest(w) AS t FROM l), e AS (SELECT DISTINCT p_type AS topic, unnest(string_split(p_name, ' ')) AS t FROM part WHERE p_size > 25)
    SELECT topic, count(*) AS words, count(e.t) AS supported, {r6('count(e.t) / count(*)')} AS support FROM lw LEFT JOIN e USING (topic, t) GROUP BY 1""",
)
def _(spark, sf):
    part = st.table(spark, sf, "part")
    lab = part.select(F.col("p_type").alias("topic"), F.explode(F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")).alias("w")).distinct().select("topic", F.array("w").alias("toks"))
    ev = part.where("p_size > 25").select(F.col("p_type").alias("topic"), F.split("p_name", " ").alias("toks"))
    return po.evidence_support(lab, ev, "topic", "toks", "toks")
