"""Queues, boards of a run, three-way joins, gates: the given tables seen as runs, assets, channels and topics."""

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.mentions import mention_facts
from tidegauge.catalog.sqlkit import MENTIONS, big, r6, ts
from tidegauge.operators import queues as qu
from tidegauge.plans import standins as st

_PATTERN = ["BUILDING", "MACHINERY", "BUILDING", "FURNITURE"]


@query(
    "queue_pattern",
    """WITH r AS (SELECT c_custkey, c_mktsegment AS t, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) - 1 AS n FROM customer)
    SELECT c_custkey, CASE WHEN t IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 0 ELSE 1 END AS phase, CASE t WHEN 'BUILDING' THEN n // 2 ELSE n END AS cycle,
    CASE t WHEN 'BUILDING' THEN (n % 2) * 2 WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 3 ELSE 0 END AS slot FROM r""",
)
def _(spark, sf):
    rows = st.table(spark, sf, "customer")
    return qu.pattern_interleave(rows, "c_mktsegment", [F.col("c_acctbal").desc(), F.col("c_custkey").asc()], _PATTERN).select("c_custkey", "phase", "cycle", "slot")


_NAMES = """l_partkey AS topic_key, l_shipdate, l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN ' ready ' ELSE 'pending' END AS name_status,
 CASE WHEN l_suppkey % 2 = 0 THEN 'ai_exact' ELSE 'raw' END AS name_source, CASE WHEN l_suppkey % 7 > 0 THEN concat('Name ', l_suppkey) ELSE ' ' END AS canonical_name"""


@query(
    "pending_first",
    f"""WITH n AS (SELECT {_NAMES} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY lineitem.l_shipdate DESC, lineitem.l_orderkey DESC, lineitem.l_linenumber DESC) = 1)
    SELECT p_partkey AS topic_key, coalesce(trim(name_status) = 'ready' AND name_source = 'ai_exact' AND trim(canonical_name) <> '', false) AS named FROM part LEFT JOIN n ON topic_key = p_partkey
    ORDER BY 2, p_size DESC, p_retailprice DESC, p_partkey LIMIT 300""",
)
def _(spark, sf):
    from tidegauge.catalog.sqlkit import split_list

    topics = st.table(spark, sf, "part").selectExpr("p_partkey AS topic_key", "p_size AS total_mentions", "p_retailprice AS unique_posts")
    names = st.table(spark, sf, "lineitem").selectExpr(*split_list(_NAMES))
    return qu.pending_first(topics, names, "topic_key", [F.col("l_shipdate").desc(), F.col("l_orderkey").desc(), F.col("l_linenumber").desc()], 300).select("topic_key", "named")


@query(
    "refresh_targets",
    """WITH n AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey AS id, o_custkey % 40 AS source, coalesce(c, 0) AS comments, o_totalprice AS score, o_orderdate AS created FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
    SELECT source, id, comments FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY comments >= 5 DESC, comments DESC, score DESC, created DESC, id) <= 15""",
)
def _(spark, sf):
    n = st.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c"))
    o = st.table(spark, sf, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left").selectExpr(
        "o_orderkey AS id", "o_custkey % 40 AS source", "coalesce(c, 0) AS comments", "o_totalprice AS score", "o_orderdate AS created")
    return qu.refresh_targets(o, "source", "id", 5, 15).select("source", "id", "comments")


_ASSETS = "p_partkey AS asset_id, DATE '1998-01-01' + CAST(p_size AS INT) AS created_at, CASE WHEN p_partkey % 3 > 0 THEN DATE '1998-02-01' + CAST(p_size % 20 AS INT) END AS updated_at, CASE WHEN p_partkey % 4 = 0 THEN DATE '1998-03-01' + CAST(p_partkey % 25 AS INT) END AS checked_at"
_DONE = "o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'succeeded' END AS status, o_shippriority + o_orderkey % 3 AS published, o_orderdate AS completed_at"


@query(
    "backfill_order",
    f"""WITH a AS (SELECT {_ASSETS} FROM part), r AS (SELECT * FROM (SELECT {_DONE.replace('o_shippriority + ', '')} FROM orders) WHERE status = 'succeeded' AND published > 0 ORDER BY completed_at DESC, run_id DESC LIMIT 12),
    s AS (SELECT l_partkey AS asset_id, max(completed_at) AS last FROM lineitem JOIN r ON run_id = l_orderkey GROUP BY 1)
    SELECT asset_id, {ts('last')} AS last_published_at FROM a LEFT JOIN s USING (asset_id) ORDER BY last IS NULL, coalesce(last, updated_at, created_at) DESC, coalesce(checked_at, updated_at, created_at), updated_at DESC NULLS LAST, asset_id DESC LIMIT 150""",
)
def _(spark, sf):
    from tidegauge.catalog.sqlkit import split_list

    assets = st.table(spark, sf, "part").selectExpr(*[x.replace("DATE '", "DATE'") for x in split_list(_ASSETS)])
    runs = st.table(spark, sf, "orders").selectExpr(*split_list(_DONE.replace("o_shippriority + ", "")))
    results = st.table(spark, sf, "lineitem").selectExpr("l_orderkey AS run_id", "l_partkey AS asset_id")
    out = qu.backfill_order(assets, runs, results, 12, 150)
    return out.select("asset_id", F.col("last_published_at").cast("timestamp_ntz").alias("last_published_at"))


_BANDS = "CASE WHEN c_acctbal >= 6000 THEN 'high' WHEN c_acctbal >= 2000 THEN 'medium' ELSE 'low' END"


@query(
    "board_distribution",
    f"""WITH g AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE b = 'high') AS high, count(*) FILTER (WHERE b = 'medium') AS medium, count(*) FILTER (WHERE b = 'low') AS low FROM (SELECT *, {_BANDS} AS b FROM customer) GROUP BY 1),
    l AS (SELECT *, CASE WHEN n >= 100 THEN 30 ELSE greatest(1, floor(n * 0.25 + 0.5)) END AS hmin, CASE WHEN n >= 100 THEN 32 ELSE floor(n * 0.25 + 0.5) END AS mmin, CASE WHEN n >= 100 THEN 25 ELSE ceil(n * 0.25) END AS lmax FROM g)
    SELECT c_nationkey, n, high, medium, low, {big('floor(high / n * 100 + 0.5)')} AS high_pct, {big('floor(medium / n * 100 + 0.5)')} AS medium_pct, {big('floor(low / n * 100 + 0.5)')} AS low_pct,
    CASE WHEN high < hmin THEN 'high too low' WHEN high > CASE WHEN n >= 100 THEN 48 ELSE greatest(hmin, floor(n * 0.52 + 0.5)) END THEN 'high too high' WHEN medium < mmin THEN 'medium too low' WHEN low > lmax THEN 'low too high' END AS rejected FROM l""",
)
def _(spark, sf):
    return qu.board_distribution(st.table(spark, sf, "customer").withColumn("b", F.expr(_BANDS)), ["c_nationkey"], "b")


@query(
    "fetch_reconcile",
    "SELECT o_custkey % 60 AS source, count(*) AS fetched, count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)) AS new, count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)) AS refreshed FROM orders GROUP BY 1",
)
def _(spark, sf):
    fetched = st.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "CAST(o_custkey % 60 AS STRING) AS source")
    stored = st.table(spark, sf, "lineitem").where("l_quantity > 40").selectExpr("l_orderkey AS id")
    return qu.reconcile_fetch(fetched, stored, "id", "source").withColumn("source", F.col("source").cast("long"))


_STATUS = "CASE WHEN l_returnflag = 'R' AND l_linenumber > 3 THEN 'failed' WHEN l_returnflag = 'A' THEN 'partial' ELSE 'success' END"


@query(
    "run_summary",
    f"""WITH b AS (SELECT l_orderkey AS run, {_STATUS} AS s, l_quantity AS fetched, CASE WHEN l_tax > 0.02 THEN l_linenumber END AS pages FROM lineitem), g AS (SELECT run, count(*) AS buckets, count(*) FILTER (WHERE s = 'success') AS succeeded, count(*) FILTER (WHERE s = 'partial') AS partly,
      count(*) FILTER (WHERE s = 'failed') AS failed, {r6('sum(fetched)')} AS fetched, {big('coalesce(sum(pages), 0)')} AS pages FROM b GROUP BY 1)
    SELECT *, CASE WHEN failed > 0 AND succeeded + partly > 0 THEN 'partial' WHEN failed > 0 THEN 'failed' ELSE 'success' END AS run_status FROM g""",
)
def _(spark, sf):
    b = st.table(spark, sf, "lineitem").selectExpr("l_orderkey AS run", f"{_STATUS} AS s", "CAST(l_quantity AS DOUBLE) AS fetched", "CASE WHEN l_tax > 0.02 THEN CAST(l_linenumber AS LONG) END AS pages")
    return qu.run_summary(b, ["run"], "s", ["fetched", "pages"])


@query(
    "channel_overview",
    f"""SELECT n_nationkey AS channel_id, n_name AS channel_name, last_id, message_count, {ts('latest')} AS latest_at FROM nation
    LEFT JOIN (SELECT s_nationkey, max(s_suppkey) AS last_id FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1) ON s_nationkey = n_nationkey
    LEFT JOIN (SELECT c_nationkey, count(*) AS message_count, max(o_orderdate) AS latest FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) ON c_nationkey = n_nationkey""",
)
def _(spark, sf):
    registry = st.table(spark, sf, "nation").selectExpr("n_nationkey AS channel_id", "n_name AS channel_name")
    state = st.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").groupBy(F.col("s_nationkey").alias("channel_id")).agg(F.max("s_suppkey").alias("last_id"))
    messages = st.table(spark, sf, "orders").join(st.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr("c_nationkey AS channel_id", "o_orderdate AS at")
    return qu.channel_overview(registry, state, messages, "channel_id", "at").withColumn("latest_at", F.col("latest_at").cast("timestamp_ntz"))


_FROM, _TO = "2024-01-05 00:00:00", "2024-01-25 00:00:00"


@query(
    "mention_posts",
    f"""WITH {MENTIONS}, p AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE concat('text ', event_id) END AS text, CASE WHEN event_id % 4 > 0 THEN event_id % 10 / 10.0 END AS q FROM events WHERE event_id % 5 > 0),
    r AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN concat('s', event_id) END AS sid, concat('raw ', event_id) AS text, event_id % 50 AS likes FROM events WHERE event_id % 7 > 0),
    j AS (SELECT m.topic_key, m.raw_post_id, m.event_timestamp, coalesce(r.sid, CAST(m.raw_post_id AS VARCHAR)) AS source_post_id, coalesce(nullif(trim(p.text), ''), r.text) AS text, coalesce(p.q, m.quality_score, 0)::DOUBLE AS quality, coalesce(r.likes, 0) AS likes
      FROM mentions m LEFT JOIN p ON p.id = m.processed_post_id LEFT JOIN r ON r.id = m.raw_post_id WHERE m.event_timestamp >= TIMESTAMP '{_FROM}' AND m.event_timestamp < TIMESTAMP '{_TO}')
    SELECT topic_key, raw_post_id, source_post_id, text, {r6('quality')} AS quality, likes FROM j QUALIFY row_number() OVER (PARTITION BY topic_key ORDER BY event_timestamp DESC, j.quality DESC, raw_post_id DESC) <= 120""",
)
def _(spark, sf):
    e = st.table(spark, sf, "events")
    processed = e.where("event_id % 5 > 0").selectExpr(
        "event_id AS id", "CAST(NULL AS STRING) AS platform", "IF(event_id % 3 = 0, ' ', concat('text ', event_id)) AS text",
        "CASE WHEN event_id % 4 > 0 THEN event_id % 10 / 10.0D END AS quality_score", "CAST(NULL AS STRING) AS author_id")
    raw = e.where("event_id % 7 > 0").selectExpr(
        "event_id AS id", "IF(event_id % 2 = 0, concat('s', event_id), NULL) AS source_post_id", "CAST(NULL AS STRING) AS platform", "concat('raw ', event_id) AS text",
        "CAST(NULL AS STRING) AS author_id", "event_id % 50 AS likes")
    out = qu.mention_posts(mention_facts(spark, sf), processed, raw, 120, st.as_of_lit(_FROM), st.as_of_lit(_TO))
    return out.select("topic_key", "raw_post_id", "source_post_id", "text", "quality", "likes")


@query(
    "processing_priority",
    f"""WITH d AS (SELECT doc_id, trim(text, ' ') AS t, doc_id % 4 AS e, doc_id % 3 AS p, doc_id % 5 AS h, doc_id % 2 AS u, doc_id % 70 AS i FROM documents), w AS (SELECT *, len(list_distinct(list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda x: length(x) >= 3))) AS n FROM d)
    SELECT doc_id, {r6("least(120.0, log2(greatest(1, i) + 1) * 22) + CASE WHEN i >= 48 THEN 60 WHEN i >= 24 THEN 40 WHEN i >= 12 THEN 24 WHEN i >= 6 THEN 12 ELSE 0 END + e * 10 + p * 12 + h * 8 + u * 6 + least(24.0, log2(n + 1) * 5) + least(18.0, log2(length(t) + 1) * 2.5) + CASE WHEN e + p + h + u > 0 THEN 10 ELSE 0 END")} AS priority FROM w""",
)
def _(spark, sf):
    d = st.table(spark, sf, "documents")
    return d.select("doc_id", qu.processing_priority("text", F.col("doc_id") % 4, F.col("doc_id") % 3, F.col("doc_id") % 5, F.col("doc_id") % 2, F.col("doc_id") % 70).alias("priority"))


@query(
    "ranked_item_estimates",
    f"""WITH r AS (SELECT p_partkey, p_partkey % 120 + 1 AS rank, CASE WHEN p_size > 3 THEN p_size END AS n, p_retailprice / 10 AS s, CASE WHEN p_partkey % 9 > 0 THEN p_partkey * 7 % 1000 END AS age FROM part)
    SELECT p_partkey, CASE WHEN age IS NULL THEN 'mixed' WHEN age <= 90 THEN 'fresh' WHEN age <= 240 THEN 'mixed' WHEN age <= 720 THEN 'delayed' ELSE 'stale' END AS freshness, CASE WHEN rank <= 20 THEN 'Established' WHEN rank <= 60 THEN 'Expanding' ELSE 'Emerging' END AS lifecycle,
    {big('greatest(greatest(1, coalesce(n, 1)), floor((101 - rank) * 18 + greatest(1, coalesce(n, 1)) * 12 + least(100.0, greatest(0.0, s)) * 4 + 0.5))')} AS activity FROM r""",
)
def _(spark, sf):
    r = st.table(spark, sf, "part").selectExpr("p_partkey", "p_partkey % 120 + 1 AS rank", "CASE WHEN p_size > 3 THEN p_size END AS n", "p_retailprice / 10 AS s", "CASE WHEN p_partkey % 9 > 0 THEN p_partkey * 7 % 1000 END AS age")
    return r.select("p_partkey", qu.snapshot_freshness("age").alias("freshness"), qu.rank_lifecycle("rank").alias("lifecycle"), qu.activity_estimate("rank", "n", "s").alias("activity"))


_CLUSTER = """p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ai' WHEN 1 THEN '#x' WHEN 2 THEN 'storm' WHEN 3 THEN '' ELSE p_name END AS key,
 CASE p_partkey % 6 WHEN 0 THEN 'AI' WHEN 1 THEN 'x' WHEN 2 THEN 'Ystorm' WHEN 3 THEN 'Named' ELSE p_name END AS label, p_size AS posts, p_size % 11 AS authors, p_partkey % 7 AS deduped, p_partkey % 30 / 100.0{d} AS coherence, p_partkey % 10 / 10.0{d} AS share, p_partkey % 12 / 12.0{d} AS short"""


@query(
    "cluster_gates",
    f"""WITH c AS (SELECT {_CLUSTER.format(d='::DOUBLE')} FROM part), i AS (SELECT *, regexp_replace(lower(key), '[^a-z0-9]+', '', 'g') AS k, regexp_replace(lower(label), '[^a-z0-9]+', '', 'g') AS l FROM c),
    m AS (SELECT *, list_filter([CASE WHEN authors < 5 THEN 'insufficient_unique_authors' END, CASE WHEN posts < 8 THEN 'insufficient_unique_posts' END, CASE WHEN authors >= 3 AND share > 0.65 THEN 'author_concentration_too_high' END, CASE WHEN short > 0.75 THEN 'short_post_ratio_too_high' END], lambda x: x IS NOT NULL) AS why FROM i),
    s AS (SELECT p_partkey, why, CASE WHEN k = '' OR l = '' OR (length(k) >= 3 AND length(l) = length(k) + 1 AND l[2:] = k) THEN 'junk key' WHEN length(l) < 3 AND l NOT IN ('ai', 'uk', 'us', 'eu') THEN 'junk label' WHEN len(why) > 0 THEN 'missing' WHEN deduped >= 4 AND coherence < 0.10 THEN 'low' WHEN deduped >= 4 AND coherence < 0.18 THEN 'mixed' ELSE 'ok' END AS x FROM m)
    SELECT p_partkey, CASE x WHEN 'junk key' THEN 'junk' WHEN 'junk label' THEN 'junk' WHEN 'missing' THEN 'insufficient_evidence' WHEN 'low' THEN 'insufficient_evidence' ELSE x END AS status,
    CASE x WHEN 'junk key' THEN 'suspicious_topic_key' WHEN 'junk label' THEN 'junk_label' WHEN 'missing' THEN array_to_string(why, '|') WHEN 'ok' THEN '' ELSE 'coherence_too_low' END AS reasons FROM s""",
)
def _(spark, sf):
    from tidegauge.catalog.sqlkit import split_list

    p = st.table(spark, sf, "part").selectExpr(*split_list(_CLUSTER.format(d="D")))
    return p.select("p_partkey", qu.cluster_status("key", "label", "posts", "authors", "authors", "deduped", "coherence", "share", "short").alias("s")).select("p_partkey", "s.*")


_LIVE = """p_partkey, CASE WHEN p_partkey % 8 > 0 THEN 'solana' ELSE ' ' END AS chain, CASE WHEN p_partkey % 5 > 0 THEN concat('pair', p_partkey) END AS pair, CASE p_partkey % 4 WHEN 0 THEN 'Live' WHEN 1 THEN 'invalid' WHEN 2 THEN ' ' END AS status,
 p_partkey % 3 = 0 AS live, p_partkey % 60 AS checked_h, p_partkey % 40 AS updated_h, p_retailprice AS liquidity, p_size * 20.0{d} AS volume, p_size % 4 AS trades"""


@query(
    "market_live_validity",
    f"""WITH a AS (SELECT *, CASE WHEN checked_h < 55 THEN checked_h END AS v FROM (SELECT {_LIVE.format(d='::DOUBLE')} FROM part)), k AS (SELECT *, trim(chain) <> '' AND pair IS NOT NULL AND coalesce(lower(trim(status)), '') <> 'invalid' AS ok, coalesce(lower(trim(status)), '') = 'live' OR live AS said FROM a)
    SELECT p_partkey, ok AND coalesce(v <= 4, false) AND said AS trusted, ok AND coalesce(v, updated_h) <= 48 AND (said OR (liquidity >= 750 AND (volume >= 400 OR trades >= 2))) AS fallback FROM k""",
)
def _(spark, sf):
    from tidegauge.catalog.sqlkit import split_list

    now = st.as_of_lit("2024-01-30 12:00:00")
    p = st.table(spark, sf, "part").selectExpr(*split_list(_LIVE.format(d="D")))
    ago = lambda h: now - F.make_interval(hours=h.cast("int"))
    p = p.withColumns({"validated": F.when(F.col("checked_h") < 55, ago(F.col("checked_h"))), "updated": ago(F.col("updated_h")), "token": F.lit("t")})
    out = qu.live_validity(now, "chain", "token", "pair", F.lit(None).cast("string"), "status", "live", "validated", "updated", "liquidity", "volume", "trades")
    return p.select("p_partkey", out.alias("r")).select("p_partkey", "r.*")


@query(
    "market_selection_score",
    f"""WITH r AS (SELECT p_partkey, p_retailprice / 20 AS corr, CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'exploratory' END AS tier, p_size * 2.0 AS market, p_size * 1.5 AS fit, p_partkey % 6 AS support, p_partkey % 5 AS hits, p_partkey % 4 AS themes, p_size - 20.0 AS fill, p_partkey % 7 AS pen FROM part)
    SELECT p_partkey, {r6("corr + CASE tier WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 0 END + least(2.5, market * 0.04) + least(2.0, fit * 0.08) + least(3.5, support) + CASE WHEN hits = 0 THEN 1.75 ELSE 0 END + greatest(0, fill * 0.05) - pen * 0.7 - (hits * 1.5 + themes * 0.5 + greatest(0, hits - 2) * 0.2)")} AS score,
    CASE WHEN corr >= 80 THEN 'High' WHEN corr >= 60 THEN 'Medium' WHEN corr >= 40 THEN 'Speculative' ELSE 'Coverage' END AS label FROM r""",
)
def _(spark, sf):
    r = st.table(spark, sf, "part").selectExpr(
        "p_partkey", "p_retailprice / 20 AS corr", "CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'exploratory' END AS tier", "p_size * 2.0D AS market", "p_size * 1.5D AS fit",
        "p_partkey % 6 AS support", "p_partkey % 5 AS hits", "p_partkey % 4 AS themes", "p_size - 20.0D AS fill", "p_partkey % 7 AS pen")
    score = qu.selection_score("corr", "tier", "market", "fit", "support", "hits", "themes", "fill", "pen", 1.5, 0.5, 2)
    return r.select("p_partkey", score.alias("score"), qu.correlation_label("corr").alias("label"))


_STOP = ["the", "and", "for", "that", "with", "was", "are"]
_W3 = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND NOT list_contains(['the','and','for','that','with','was','are'], x) AND NOT regexp_matches(x, '^[0-9]+$'))"


@query(
    "breakout_phrases",
    f"""WITH w AS (SELECT doc_id, source, 1 + log10(n_chars + 1) AS weight, {_W3} AS w FROM documents),
    c AS (SELECT doc_id, source, weight, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (3), (2)) v(n) WHERE len(w) >= n)),
    f AS (SELECT DISTINCT doc_id, source, weight, phrase FROM c)
    SELECT phrase, count(DISTINCT source) AS sources, {r6('sum(weight)')} AS weight FROM f GROUP BY 1""",
)
def _(spark, sf):
    d = st.table(spark, sf, "documents").withColumn("weight", 1 + F.log10(F.col("n_chars") + 1))
    return qu.breakout_phrases(d, "text", "source", "weight", _STOP)


_RAW = """o_orderkey AS id, CASE WHEN o_orderkey % 10 > 0 THEN o_orderstatus END AS platform, CASE WHEN o_orderkey % 3 = 0 THEN concat('s', o_orderkey) END AS source_post_id,
 CASE WHEN o_orderkey % 4 > 0 THEN concat('p', o_orderkey) END AS post_id, CAST(o_orderdate AS TIMESTAMP{n}) AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN concat('raw ', o_custkey) END AS raw_text, concat('text ', o_custkey) AS text_content, CASE WHEN o_custkey % 5 = 0 THEN 'x' END AS reply_parent_id"""


@query(
    "processed_refresh",
    f"""SELECT id AS raw_post_id, platform, coalesce(source_post_id, post_id) AS source_post_id, {ts("date_trunc('minute', created_at)")} AS bucket_minute, coalesce(raw_text, text_content) AS clean_text, reply_parent_id IS NOT NULL AS is_reply, 'general' AS tags
    FROM (SELECT {_RAW.format(n='')} FROM orders) WHERE platform IS NOT NULL AND coalesce(source_post_id, post_id) IS NOT NULL""",
)
def _(spark, sf):
    from tidegauge.catalog.sqlkit import split_list
    from tidegauge.operators import merges as me

    raw = st.table(spark, sf, "orders").selectExpr(*split_list(_RAW.format(n="_NTZ"))).selectExpr(
        "*", "CAST(NULL AS STRING) AS author_id", "CAST(NULL AS TIMESTAMP_NTZ) AS ingested_at", "CAST(NULL AS ARRAY<STRING>) AS hashtags", "CAST(NULL AS ARRAY<STRING>) AS urls", "CAST(NULL AS STRING) AS repost_of_uri")
    return me.refresh_processed(raw).select("raw_post_id", "platform", "source_post_id", "bucket_minute", "clean_text", "is_reply", "tags").withColumn(
        "bucket_minute", F.col("bucket_minute").cast("timestamp_ntz"))


@query(
    "source_catalog",
    """WITH b AS (SELECT p_name AS name, 'own' AS category, p_size AS priority, 0 AS found FROM part WHERE p_partkey % 4 = 0 UNION ALL
      SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE concat(p_name, ' ', p_brand) END, p_type, p_size + 5, 1 FROM (SELECT *, p_retailprice * 20 AS subs, p_size / 4.0 AS per_day FROM part) WHERE p_type IS NOT NULL
        AND p_partkey % 9 > 0 AND NOT (subs < 15000 AND per_day < 5) AND NOT (p_partkey % 2 = 0 AND subs < 100000 AND per_day < 12))
    SELECT lower(name) AS key, name, category, priority, found FROM b QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY found, category, priority DESC, name) = 1""",
)
def _(spark, sf):
    from tidegauge.operators import merges as me

    part = st.table(spark, sf, "part")
    found = part.selectExpr("CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE concat(p_name, ' ', p_brand) END AS name", "p_type AS category", "p_size + 5 AS priority", "p_retailprice * 20 AS subscribers", "CAST(p_size / 4.0 AS DOUBLE) AS posts_per_day",
                            "p_partkey % 9 = 0 AS blocked", "p_partkey % 2 = 0 AS spam_prone")
    own = part.where("p_partkey % 4 = 0").selectExpr("p_name AS name", "'own' AS category", "p_size AS priority")
    return me.source_catalog(own, found).select("key", "name", "category", "priority", "found")


@query(
    "channel_diagnostics",
    f"""SELECT n_name AS channel_ref, coalesce(k, 0) AS channel_id, k IS NOT NULL AS resolved, CASE WHEN k IS NOT NULL THEN coalesce(m, 0) END AS messages, {ts('latest')} AS latest_at, CASE WHEN k IS NOT NULL THEN s END AS last_status FROM nation
    LEFT JOIN (SELECT n_name AS r, n_nationkey AS k FROM nation WHERE n_nationkey % 4 > 0) ON r = n_name LEFT JOIN (SELECT c_nationkey, count(*) AS m, max(o_orderdate) AS latest FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey % 6 > 0 GROUP BY 1) ON c_nationkey = k
    LEFT JOIN (SELECT s_nationkey, CASE WHEN sum(s_acctbal) > 0 THEN 'ok' ELSE 'failed' END AS s FROM supplier GROUP BY 1) ON s_nationkey = k""",
)
def _(spark, sf):
    from tidegauge.operators import merges as me

    nation = st.table(spark, sf, "nation")
    messages = st.table(spark, sf, "orders").join(st.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey % 6 > 0").selectExpr("c_nationkey AS channel_id", "o_orderdate AS at")
    state = st.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("channel_id")).agg(F.when(F.sum("s_acctbal") > 0, "ok").otherwise("failed").alias("last_status"))
    out = me.channel_diagnostics(nation.selectExpr("n_name AS channel_ref"), nation.where("n_nationkey % 4 > 0").selectExpr("n_name AS channel_ref", "n_nationkey AS channel_id"), state, messages)
    return out.withColumn("latest_at", F.col("latest_at").cast("timestamp_ntz"))


_MEMBER = """p_brand AS cluster, p_name AS label, p_size AS weight, CASE WHEN p_partkey % 3 > 0 THEN concat('Name ', p_partkey) END AS name, p_partkey % 5 = 0 AS trusted, CASE WHEN p_partkey % 2 = 0 THEN 'ok' ELSE 'mixed' END AS status, concat('about ', p_partkey) AS description, p_type AS e"""


@query(
    "cluster_synthesis",
    f"""WITH m AS (SELECT {_MEMBER} FROM part), le AS (SELECT cluster, description, status AS ls FROM m WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, label, name) = 1),
    su AS (SELECT cluster, name AS sure_name FROM m WHERE name IS NOT NULL AND trusted QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, label, name) = 1),
    en AS (SELECT cluster, lower(x) AS k, count(*) AS n, min(x) AS e FROM (SELECT cluster, unnest([e, label]) AS x FROM m) GROUP BY 1, 2), ke AS (SELECT cluster, string_agg(e, '|' ORDER BY n DESC, k) AS key_entities FROM (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, k) <= 6) GROUP BY 1)
    SELECT c.cluster, description, sure_name, key_entities, CASE WHEN sure_name IS NOT NULL THEN 'mixed' ELSE coalesce(ls, 'insufficient_evidence') END AS status FROM (SELECT DISTINCT cluster FROM m) c LEFT JOIN le USING (cluster) LEFT JOIN su USING (cluster) LEFT JOIN ke USING (cluster)""",
)
def _(spark, sf):
    from tidegauge.catalog.sqlkit import split_list
    from tidegauge.operators import merges as me

    m = st.table(spark, sf, "part").selectExpr(*split_list(_MEMBER)).withColumn("entities", F.array("e"))
    return me.cluster_synthesis(m, "cluster", "label", "weight", "trusted", "entities").select("cluster", "description", "sure_name", "key_entities", "status")


_READ = """p_partkey AS root, CASE WHEN p_partkey % 6 > 0 THEN p_size END AS author, CASE WHEN p_partkey % 4 > 0 THEN concat('Key-', p_brand) END AS semantic_key, p_name AS label, p_retailprice / 30 AS quality, p_partkey % 7 = 0 AS is_template, p_size / 60.0 AS spam"""


@query(
    "semantic_candidates",
    f"""WITH r AS (SELECT {_READ}, p_type AS s1, p_brand AS s2 FROM part), n AS (SELECT *, nullif(trim(regexp_replace(lower(coalesce(semantic_key, label)), '[^a-z0-9]+', ' ', 'g')), '') AS k, trim(regexp_replace(lower(s1), '[^a-z0-9]+', ' ', 'g')) AS k1, trim(regexp_replace(lower(s2), '[^a-z0-9]+', ' ', 'g')) AS k2 FROM r),
    o AS (SELECT *, list_filter(CASE WHEN k1 = k2 THEN [k1] ELSE [k1, k2] END, lambda x: x <> '' AND x IS DISTINCT FROM k) AS other FROM n)
    SELECT root, 'ai:' || k AS key, 'ai_semantic' AS kind, {r6('quality')} AS quality, 580 AS priority FROM o WHERE k IS NOT NULL UNION ALL
    SELECT root, 'ai:' || other[i], 'ai_semantic', {r6('greatest(0, quality - i * 4)')}, 520 - (i - 1) * 12 FROM (SELECT *, unnest(range(1, len(other) + 1)) AS i FROM o) UNION ALL
    SELECT root, 'template:' || trim(regexp_replace(lower(author || ' ' || coalesce(semantic_key, label)), '[^a-z0-9]+', ' ', 'g')), 'author_template', {r6('greatest(0, least(100, quality - 8))')}, 560 FROM o WHERE author IS NOT NULL AND (is_template OR spam >= 0.72)""",
)
def _(spark, sf):
    from tidegauge.catalog.sqlkit import split_list
    from tidegauge.operators import merges as me

    part = st.table(spark, sf, "part")
    rows = part.selectExpr(*split_list(_READ), "array(p_type, p_brand) AS secondary_keys")
    read = rows.selectExpr("root", "semantic_key", "label", "quality", "is_template", "CAST(spam AS DOUBLE) AS spam_likelihood", "0.0D AS template_likelihood", "secondary_keys")
    return me.semantic_candidates(rows.select("root", "author"), read, "root", "author")


@query(
    "representative_counts",
    """SELECT p_partkey, 1 AS posts, CAST(greatest(2, floor(greatest(0, floor(p_retailprice + 0.5)) / 90 + 0.5)) AS BIGINT) AS reposts, CAST(greatest(1, least(greatest(1, p_size), greatest(1, p_partkey % 6) * 2)) AS BIGINT) AS comments, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS likes FROM part""",
)
def _(spark, sf):
    from tidegauge.operators import merges as me

    p = st.table(spark, sf, "part")
    return p.select("p_partkey", me.representative_counts("p_retailprice", "p_size", F.col("p_partkey") % 6).alias("r")).select("p_partkey", "r.*")


@query(
    "mapped_groups",
    f"""WITH g AS (SELECT p_type AS key, count(*) AS posts, {big('sum(p_size)')} AS likes, list_sort(list(DISTINCT p_brand)) AS brands FROM part GROUP BY 1), m AS (SELECT DISTINCT p_type AS k, upper(left(p_type, 2)) AS cl FROM part WHERE p_size > 25),
    j AS (SELECT *, coalesce(cl, key) AS cluster FROM g LEFT JOIN m ON k = key)
    SELECT cluster, arg_max(key, {{'a': posts, 'b': key}}) AS lead, count(*) AS groups, {big('sum(posts)')} AS posts, {big('sum(likes)')} AS likes, array_to_string(list_sort(list_distinct(flatten(list(brands)))), '|') AS brands FROM j GROUP BY 1""",
)
def _(spark, sf):
    from tidegauge.operators import merges as me

    part = st.table(spark, sf, "part")
    groups = part.groupBy(F.col("p_type").alias("key")).agg(F.count(F.lit(1)).alias("posts"), F.sum("p_size").alias("likes"), F.sort_array(F.collect_set("p_brand")).alias("brands"))
    mapping = part.where("p_size > 25").select(F.col("p_type").alias("key"), F.upper(F.substring("p_type", 1, 2)).alias("cluster")).distinct()
    return me.apply_mapping(groups, mapping, "key", ["posts", "likes"], ["brands"])


_NAMED = """p_partkey, CASE p_partkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'Parliament' ELSE p_name END AS raw_label, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) WHEN p_partkey % 5 < 4 THEN concat('Storm over ', p_brand) END AS canonical_name,
 CASE WHEN p_partkey % 3 = 0 THEN p_type END AS fallback_label, CASE p_partkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'mixed' WHEN 2 THEN 'junk' ELSE 'insufficient_evidence' END AS status, 'ready' AS name_status, CASE p_partkey % 6 WHEN 0 THEN 'historical_exact' WHEN 1 THEN 'x' END AS name_source,
 CASE WHEN p_partkey % 11 = 0 THEN 'This is Using the cleaned fallback label now' ELSE 'fine' END AS narrative_summary, CASE WHEN p_partkey % 13 = 0 THEN 'Visible runtime AI naming failed' END AS abstain_reason, CASE WHEN p_partkey % 17 = 0 THEN 'Visible_Runtime_OpenAI_Failure' ELSE 'noise' END AS sig,
 p_partkey % 19 = 0 AS used_fallback, p_size % 2 = 0 AS authoritative, p_size > 5 AS shaped, p_size % 4 AS n_evidence"""
_BROKEN = "(lower(sig) = 'visible_runtime_openai_failure' OR lower(narrative_summary) LIKE '%using the cleaned fallback label%' OR coalesce(lower(abstain_reason), '') LIKE '%visible runtime ai naming failed%')"


@query(
    "name_state",
    f"""WITH n AS (SELECT {_NAMED} FROM part), v AS (SELECT *, nullif(trim(raw_label), '') AS l, coalesce(fallback_label, nullif(trim(raw_label), '')) AS fb, CASE WHEN lower(canonical_name) IS DISTINCT FROM lower(nullif(trim(raw_label), '')) THEN canonical_name END AS nm, {_BROKEN} AS broken FROM n),
    r AS (SELECT *, nm IS NOT NULL AND status IN ('ok', 'mixed') AND NOT used_fallback AND NOT broken AND shaped AS ready FROM v)
    SELECT p_partkey, CASE WHEN ready THEN nm END AS canonical, fb AS fallback, CASE WHEN ready THEN 'ready' WHEN status IN ('junk', 'insufficient_evidence') AND NOT broken THEN 'failed' ELSE 'pending' END AS name_status,
    CASE WHEN ready AND name_source = 'historical_exact' THEN name_source WHEN ready AND authoritative THEN 'ai_exact' WHEN ready THEN 'historical_alias' WHEN fb IS NOT NULL THEN 'fallback_cleaned' ELSE 'none' END AS name_source FROM r""",
)
def _(spark, sf):
    from tidegauge.catalog.sqlkit import split_list
    from tidegauge.operators import merges as me

    n = st.table(spark, sf, "part").selectExpr(*split_list(_NAMED)).withColumn("signals", F.array("sig"))
    out = me.name_state("raw_label", "canonical_name", "fallback_label", "status", "name_source", "narrative_summary", "abstain_reason", "signals", "used_fallback", "authoritative", "shaped")
    return n.select("p_partkey", out.alias("r")).select("p_partkey", "r.*")


@query(
    "quarantined_names",
    f"""WITH n AS (SELECT {_NAMED} FROM part), q AS (SELECT *, CASE WHEN lower(narrative_summary) LIKE '%using the cleaned fallback label%' THEN 'fallback_narrative' WHEN coalesce(lower(abstain_reason), '') LIKE '%visible runtime ai naming failed%' OR lower(sig) = 'visible_runtime_openai_failure' THEN 'runtime_failure'
      WHEN status IN ('ok', 'mixed') AND lower(canonical_name) = lower(nullif(trim(raw_label), '')) THEN 'canonical_equals_raw' WHEN status IN ('ok', 'mixed') AND n_evidence = 0 THEN 'missing_evidence'
      WHEN status IN ('ok', 'mixed') AND regexp_matches(regexp_replace(lower(raw_label), '[^a-z0-9]+', '', 'g'), '(?:apital|eneral|etting|hased|arket|tion|ment|ally|ized)$') THEN 'fragment_like_raw_label' END AS reason FROM n)
    SELECT p_partkey, reason, CASE WHEN reason IS NULL THEN fallback_label ELSE coalesce(fallback_label, nullif(trim(raw_label), '')) END AS fallback_label, CASE WHEN reason IS NULL THEN canonical_name END AS canonical_name,
    CASE WHEN reason = 'runtime_failure' THEN 'pending' WHEN reason IS NOT NULL THEN 'failed' ELSE name_status END AS name_status, CASE WHEN reason IS NULL THEN name_source WHEN trim(raw_label) <> '' THEN 'fallback_cleaned' ELSE 'none' END AS name_source FROM q""",
)
def _(spark, sf):
    from tidegauge.catalog.sqlkit import split_list
    from tidegauge.operators import merges as me

    n = st.table(spark, sf, "part").selectExpr(*split_list(_NAMED)).withColumns({"mixed_signals": F.array("sig"), "evidence": F.array_repeat(F.lit(1), F.col("n_evidence").cast("int"))})
    return me.quarantine_names(n).select("p_partkey", "reason", "fallback_label", "canonical_name", "name_status", "name_source")
