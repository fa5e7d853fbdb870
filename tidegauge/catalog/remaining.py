"""Scalar functions on whole tables, delta documents, author profiles, band counts, board fill."""

from pyspark.sql import functions as F

from tidegauge import fixed
from tidegauge.catalog import query
from tidegauge.catalog.engagement import R1, _DELTAS, _SNAPS, _C, snaps
from tidegauge.catalog.sqlkit import arr, big, r6, ts
from tidegauge.functions import basic as bs, scores as sc, text as tx
from tidegauge.operators import engagement as en, grouping as gr, posts as po
from tidegauge.operators.windows import best
from tidegauge.plans import standins as st


@query(
    "time_functions",
    f"""SELECT event_id, {ts("date_trunc('minute', ts)")} AS minute, {ts("date_trunc('hour', ts)")} AS hour, {ts("time_bucket(INTERVAL 5 MINUTE, ts)")} AS five, {ts("to_timestamp(floor(epoch(ts) / 1800) * 1800)::TIMESTAMP")} AS thirty,
    {r6("greatest(0, (1706616000 - floor(epoch(ts))) / 3600)")} AS age_hours, len(range(CAST(ts AS DATE), CAST(ts + INTERVAL 30 HOUR AS DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS days_touched FROM events""",
)
def _(spark, sf):
    e = st.table(spark, sf, "events")
    return e.select(
        "event_id", F.date_trunc("minute", "ts").alias("minute"), F.date_trunc("hour", "ts").alias("hour"), bs.floor_minutes("ts", 5).alias("five"),
        bs.floor_minutes("ts", 30).alias("thirty"), bs.age_hours(st.as_of_lit(), "ts").alias("age_hours"),
        F.size(bs.day_list("ts", F.col("ts") + F.expr("INTERVAL 30 HOURS"))).alias("days_touched"))


@query(
    "json_functions",
    """SELECT event_id, CAST(coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN 'a|' || event_id END AS tags FROM events""",
)
def _(spark, sf):
    e = st.table(spark, sf, "events").withColumn("doc", F.expr("IF(event_id % 2 = 0, concat('[\"a\",\"', event_id, '\"]'), '{\"x\":1}')"))
    tags = F.from_json("doc", "array<string>")
    return e.select(
        "event_id", F.coalesce(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k")).cast("long").alias("k"),
        F.when(F.col("doc").startswith("["), F.concat_ws("|", tags)).alias("tags"))


@query(
    "number_functions",
    f"""SELECT o_orderkey, {r6('floor(round(CAST((o_totalprice - 250000) * 10 AS DOUBLE), 9) + 0.5) / 10')} AS rounded, {r6('(o_totalprice - o_custkey) / greatest(o_custkey, 1.0::DOUBLE) * 100')} AS change,
    {r6('CASE WHEN o_custkey <= 0 THEN 100 ELSE (o_totalprice - o_custkey) / o_custkey * 100 END')} AS delta, {r6('least(100, greatest(0, log10(o_totalprice + 1) / log10(500001) * 100))')} AS log_score,
    {r6('least(100, greatest(0, (o_totalprice - 1000) / 399000 * 100))')} AS linear_score FROM orders""",
)
def _(spark, sf):
    o = st.table(spark, sf, "orders")
    return o.select(
        "o_orderkey", bs.round1(F.col("o_totalprice") - 250000).alias("rounded"), bs.pct_change("o_totalprice", "o_custkey").alias("change"),
        bs.delta_pct("o_totalprice", "o_custkey").alias("delta"), bs.log_score("o_totalprice", 500000).alias("log_score"),
        bs.linear_score("o_totalprice", 1000, 400000).alias("linear_score"))


@query(
    "blank_cleanup",
    "SELECT p_partkey, nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_name END), '') AS name, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_name END), ''), nullif(trim(p_brand), '')) AS shown FROM part",
)
def _(spark, sf):
    p = st.table(spark, sf, "part").withColumn("n", F.expr("IF(p_size % 3 = 0, '  ', p_name)"))
    return p.select("p_partkey", bs.blank_to_null("n").alias("name"), bs.first_filled("n", "p_brand").alias("shown"))


@query(
    "array_set_algebra",
    """WITH a AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS x, list_sort(list_distinct(list(o_orderstatus))) AS y FROM orders GROUP BY 1)
    SELECT o_custkey, len(list_intersect(x, ['1-URGENT','2-HIGH'])) AS urgent, len(list_distinct(list_concat(x, y))) AS merged, """ + r6("len(list_intersect(x, ['1-URGENT','2-HIGH'])) / len(list_distinct(list_concat(x, ['1-URGENT','2-HIGH'])))") + """ AS jaccard,
    """ + r6("len(list_intersect(x, ['1-URGENT','2-HIGH'])) / least(len(x), 2)") + """ AS overlap FROM a""",
)
def _(spark, sf):
    a = st.table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("x"), F.collect_set("o_orderstatus").alias("y"))
    hot = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return a.select(
        "o_custkey", F.size(F.array_intersect("x", hot)).alias("urgent"), F.size(F.array_union("x", "y")).alias("merged"),
        tx.jaccard("x", hot).alias("jaccard"), tx.overlap_coefficient("x", hot).alias("overlap"))


@query(
    "discovery_weights",
    f"""WITH e AS (SELECT event_id, value, CASE event_id % 6 WHEN 0 THEN 'comment' WHEN 1 THEN 'delta' WHEN 2 THEN 'quote' WHEN 3 THEN 'reply' WHEN 4 THEN 'amplification' ELSE 'post' END AS kind, user_id, event_type FROM events),
    w AS (SELECT *, (1 + least(8.0, value / 20) + least(4.0, event_id % 300 / 60)) * CASE kind WHEN 'comment' THEN 0.6 WHEN 'delta' THEN 0.35 ELSE 1 END::DOUBLE * CASE WHEN event_id % 7 = 0 AND event_id % 4 > 0 THEN 0.18 ELSE 1 END::DOUBLE
      * CASE WHEN event_id % 11 = 0 THEN 0.42 ELSE 1 END::DOUBLE * CASE WHEN event_id % 5 = 0 AND event_id % 4 > 0 THEN 0.58 ELSE 1 END::DOUBLE AS w FROM e)
    SELECT event_id, {r6(R1("CASE WHEN event_type = 'view' THEN w * CASE kind WHEN 'quote' THEN 1.18 ELSE 1 END::DOUBLE * CASE kind WHEN 'reply' THEN 0.96 ELSE 1 END::DOUBLE * CASE kind WHEN 'amplification' THEN 0.52 ELSE 1 END::DOUBLE * CASE WHEN event_id % 2 = 0 THEN 0.92 ELSE 1 END::DOUBLE + least(2.5::DOUBLE, log10(user_id + 1) * 0.7::DOUBLE) ELSE w END"))} AS weight FROM w""",
)
def _(spark, sf):
    e = st.table(spark, sf, "events").withColumn("kind", F.expr(
        "CASE event_id % 6 WHEN 0 THEN 'comment' WHEN 1 THEN 'delta' WHEN 2 THEN 'quote' WHEN 3 THEN 'reply' WHEN 4 THEN 'amplification' ELSE 'post' END"))
    m = lambda n: F.col("event_id") % n == 0
    return e.select("event_id", sc.discovery_weight(
        "value", F.col("event_id") % 300, "kind", m(7), m(11), m(5), m(4), F.col("event_type") == "view", "kind", "user_id", m(2)).alias("weight"))


@query(
    "refresh_priority",
    f"SELECT event_id, {r6('value + log10(user_id + 1) * 7 + log10(event_id % 9 + 1) * 4 + greatest(0, 48.0 - greatest(1.0, (1706616000 - floor(epoch(ts))) / 60) / 60)')} AS priority FROM events",
)
def _(spark, sf):
    age = (F.lit(1706616000) - F.unix_timestamp("ts")) / 60
    return st.table(spark, sf, "events").select("event_id", sc.refresh_priority("value", "user_id", F.col("event_id") % 9, age).alias("priority"))


@query(
    "delta_documents",
    f"""WITH {_SNAPS}, {_DELTAS}, s AS (SELECT event_id, item, {R1("least(24.0::DOUBLE, log10(greatest((delta_reposts + delta_quotes) / greatest(delta_minutes / 60, 0.25), 0) + 1) * 11) + least(18.0::DOUBLE, log10(greatest(delta_replies / greatest(delta_minutes / 60, 0.25), 0) + 1) * 9) + least(12.0::DOUBLE, log10(greatest(delta_likes / greatest(delta_minutes / 60, 0.25), 0) + 1) * 5)")} AS score FROM deltas)
    SELECT event_id, item, {r6('score')} AS score, p_name AS title FROM s JOIN part ON p_partkey = item WHERE score > 0""",
)
def _(spark, sf):
    d = en.snapshot_deltas(snaps(spark, sf), "item", "ts", _C)
    d = d.withColumn("score", sc.snapshot_score("delta_reposts", "delta_quotes", "delta_replies", "delta_likes", "delta_minutes"))
    posts = st.table(spark, sf, "part").selectExpr("p_partkey AS item", "p_name AS title")
    return po.delta_documents(d, posts, "item", "score").select("event_id", "item", "score", "title")


@query(
    "author_profiles",
    f"SELECT user_id, {ts('min(ts)')} AS first_seen, {ts('max(ts)')} AS last_seen, count(*) AS posts, {r6('sum(value)')} AS amplification, count(DISTINCT props) AS subjects FROM events GROUP BY 1",
)
def _(spark, sf):
    return st.table(spark, sf, "events").groupBy("user_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("posts"), F.sum("value").alias("amplification"),
        F.count_distinct("props").alias("subjects"))


@query(
    "naming_completeness",
    "SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size > 30) AS ready, count(*) FILTER (WHERE p_size <= 30 AND p_size > 10) AS pending, count(*) FILTER (WHERE p_size <= 10) AS missing FROM part GROUP BY 1",
)
def _(spark, sf):
    return st.table(spark, sf, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 30).alias("ready"), F.count_if(F.col("p_size").between(11, 30)).alias("pending"),
        F.count_if(F.col("p_size") <= 10).alias("missing"))


@query(
    "meme_scope",
    f"SELECT event_id FROM ({st.MEME_SQL}) WHERE len(list_filter(string_split(lower(text), ' '), lambda t: list_contains({arr(fixed.MEME_KEYWORDS)}, t))) > 0",
)
def _(spark, sf):
    words = F.array(*[F.lit(w) for w in fixed.MEME_KEYWORDS])
    return st.meme_posts(spark, sf).where(F.arrays_overlap(F.split(F.lower("text"), " ", -1), words)).select("event_id")


@query("board_fill")
def _(spark, sf):
    """Fresh rows first, older rows only where they overlap none already on the board."""
    rows = st.table(spark, sf, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("score"), F.sort_array(F.collect_set(F.date_format("l_shipdate", "MM-dd"))).alias("evidence"))
    order = [F.col("year").desc(), F.col("score").desc(), F.col("l_suppkey").asc()]
    return gr.overlap_board(rows, "l_suppkey", order, {"evidence": 0.34}, 30).select("l_suppkey", "year", "score", "place")
