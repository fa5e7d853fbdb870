"""Datasets written to the shared folder and read back, backlog, cursors, run-versioned outputs, refreshes."""

from datetime import datetime

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.mentions import mention_facts
from tidegauge.catalog.sqlkit import MENTIONS, MINUTES, big, r6, ts
from tidegauge.plans import readmodel as rm, standins as st
from tidegauge.session import materialise, scratch_path
from tidegauge.sources import datasets as ds, publication as pb


@query("landed_json_roundtrip", f"SELECT CAST(doc_id AS VARCHAR) AS id, source, text, n_chars AS score FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "landed")
    d = st.table(spark, sf, "documents").selectExpr("CAST(doc_id AS STRING) AS id", "source", "text", "n_chars AS score")
    ds.write_dataset(d, path, "json")
    return ds.read_landed(spark, path, "posts").select("id", "source", "text", "score")


@query("run_log", f"SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 20")
def _(spark, sf):
    path = scratch_path(spark, "runlog")
    o = st.table(spark, sf, "orders").selectExpr("CAST(o_orderkey AS STRING) AS runId", "o_orderstatus AS status", "o_orderdate AS startedAt")
    ds.append_run(o.where("startedAt < DATE'1998-01-01'"), path)
    ds.append_run(o.where("startedAt >= DATE'1998-01-01'"), path)
    return ds.last_runs(ds.read_landed(spark, path, "runs"), "startedAt").selectExpr("CAST(runId AS LONG) AS id", "status")


@query("resume_cursor", "SELECT o_custkey AS source, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS cursor FROM orders GROUP BY 1")
def _(spark, sf):
    return ds.resume_cursor(st.table(spark, sf, "orders").withColumnRenamed("o_custkey", "source"), "source", "o_orderkey", "o_orderdate")


@query("backlog_oldest", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) ORDER BY c_acctbal, c_custkey LIMIT 500")
def _(spark, sf):
    done = st.table(spark, sf, "orders").where("o_totalprice > 450000").selectExpr("o_custkey AS c_custkey")
    return ds.oldest(ds.backlog(st.table(spark, sf, "customer"), done, "c_custkey"), "c_acctbal", "c_custkey", 500).select("c_custkey")


@query("channel_messages", f"SELECT doc_id AS message_id FROM documents WHERE source = 'src1' ORDER BY n_chars DESC, doc_id DESC LIMIT 25")
def _(spark, sf):
    d = st.table(spark, sf, "documents").selectExpr("doc_id AS message_id", "source", "n_chars AS timestamp")
    return ds.channel_messages(d, F.col("source") == "src1", 25).select("message_id")


@query(
    "normalised_messages",
    "SELECT c_custkey, c_custkey % 40 AS channel_id, c_mktsegment AS channel_name, CASE WHEN c_custkey % 3 = 0 THEN 'photo' WHEN c_custkey % 3 = 1 THEN 'video' ELSE 'text' END AS media_type, c_nationkey::BIGINT AS views, 'https://t.example/c/' || c_custkey % 40 || '/' || c_custkey AS message_url FROM customer",
)
def _(spark, sf):
    pay = """concat('{"id":', c_custkey, ',"chat":{"id":', c_custkey % 40, ',"title":"', c_mktsegment, '"},"content":{"text":"x"', CASE c_custkey % 3 WHEN 0 THEN ',"photo":"p"' WHEN 1 THEN ',"video":"v"' ELSE '' END, '},"views":', c_nationkey, '}')"""
    rows = st.table(spark, sf, "customer").selectExpr("c_custkey", f"{pay} AS payload")
    return ds.normalise_messages(rows, "payload", "c_custkey").select("c_custkey", "channel_id", "channel_name", "media_type", "views", "message_url")


@query("feed_items", "SELECT 'page' AS sourceType, CAST(page_id AS VARCHAR) AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url FROM pages")
def _(spark, sf):
    p = st.table(spark, sf, "pages")
    return ds.feed_items(p, "page", {"id": F.col("page_id").cast("string"), "title": F.regexp_extract("html", "<title>([^<]*)</title>", 1), "url": F.col("url")}).select("sourceType", "id", "title", "url")


@query(
    "range_replace",
    f"SELECT event_id, {r6("CASE WHEN ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00' THEN value * 2 ELSE value END")} AS value FROM events",
)
def _(spark, sf):
    path = scratch_path(spark, "events")
    e = st.table(spark, sf, "events").select("event_id", "value", "ts")
    ds.write_dataset(e.withColumn("day", F.to_date("ts")).repartition("day"), path, partition_by=["day"])
    lo, hi = st.as_of_lit("2024-01-10 06:00:00"), st.as_of_lit("2024-01-12 18:00:00")
    fresh = e.where((F.col("ts") >= lo) & (F.col("ts") < hi)).withColumn("value", F.col("value") * 2)
    ds.replace_days(spark.read.parquet(path), fresh, path, "ts", lo, hi)
    return spark.read.parquet(path).select("event_id", "value")


@query(
    "range_emptied",
    "SELECT event_id FROM events WHERE NOT (ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00')",
)
def _(spark, sf):
    path = scratch_path(spark, "events")
    e = st.table(spark, sf, "events").select("event_id", "ts")
    ds.write_dataset(e.withColumn("day", F.to_date("ts")).repartition("day"), path, partition_by=["day"])
    lo, hi = st.as_of_lit("2024-01-10 06:00:00"), st.as_of_lit("2024-01-12 18:00:00")
    ds.replace_days(spark.read.parquet(path), e.limit(0), path, "ts", lo, hi)  # nothing new: the range is only deleted
    return spark.read.parquet(path).select("event_id")


@query("run_versioned_publish", "SELECT 'r2' AS run_id, count(*) AS assets, count(DISTINCT p_brand) AS brands FROM part")
def _(spark, sf):
    root = scratch_path(spark, "published")
    part = st.table(spark, sf, "part").withColumn("asset_id", ds.surrogate_id("p_partkey", "p_name"))
    for run in ("r1", "r2", "r2"):
        ds.publish_run({"assets": part, "brands": part.select("p_brand").distinct()}, root, run)
    count = lambda t: spark.read.option("basePath", f"{root}/{t}").parquet(f"{root}/{t}/run_id=*").where("run_id = 'r2'").groupBy("run_id").agg(F.count(F.lit(1)).alias(t))
    return count("assets").join(count("brands"), "run_id")


@query(
    "published_runs",
    f"SELECT p_partkey AS asset, {r6('p_retailprice * 2')} AS price, b.parts AS brand_parts, 'r2' AS run_id FROM part JOIN (SELECT p_brand, count(*) AS parts FROM part GROUP BY 1) b USING (p_brand)",
)
def _(spark, sf):
    root = scratch_path(spark, "runs")
    part = st.table(spark, sf, "part").selectExpr("p_partkey AS asset", "p_brand", "p_retailprice AS price")
    brands = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))
    run = lambda factor: {"assets": part.withColumn("price", F.col("price") * factor), "brands": brands}
    pb.publish(spark, root, "r1", run(1))
    pb.publish(spark, root, "r2", run(3))
    pb.publish(spark, root, "r2", run(2))  # the same run again
    broken = run(5) | {"brands": brands.limit(0)}
    try:
        pb.publish(spark, root, "r3", broken, least={"brands": 1})  # its assets are written, its brands are not: it stays unseen
    except pb.PublicationError:
        pass
    seen = pb.read_tables(spark, root)
    last = pb.visible_runs(spark, root).orderBy(F.desc("seq")).first()["run_id"]
    return seen["assets"].join(seen["brands"], "p_brand").select("asset", "price", F.col("parts").alias("brand_parts"), F.lit(last).alias("run_id"))


@query(
    "read_model_refresh",
    f"""WITH {MINUTES}, r AS (SELECT * FROM minutes WHERE bucket_minute < TIMESTAMP '2024-01-30 11:57:00')
    SELECT CAST(CAST(bucket_minute AS DATE) AS VARCHAR) AS day, topic_key, {big('sum(mention_count)')} AS total_mentions, {big('sum(unique_posts)')} AS unique_posts FROM r GROUP BY CAST(bucket_minute AS DATE), topic_key HAVING sum(mention_count) >= 2""",
)
def _(spark, sf):
    root = scratch_path(spark, "readmodel")
    facts = materialise(mention_facts(spark, sf), "mention-facts")  # written once, read by every step of both runs
    # a first run over everything, then an incremental one that re-reads the overlap only
    _, end = rm.refresh(spark, facts, root, datetime(2024, 1, 28, 12), None)
    rm.refresh(spark, facts, root, datetime(2024, 1, 30, 12), end)
    rm.register_views(spark, root)
    return spark.table("topic_day_totals").select(F.col("day").cast("string"), "topic_key", "total_mentions", "unique_posts")


@query(
    "snapshot_document",
    """WITH t AS (SELECT o_custkey % 50 AS source, o_orderkey AS id, o_orderdate AS created FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate DESC, o_orderkey) <= 20), n AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1)
    SELECT source, '[' || string_agg(concat('{"id":', id, ',"comments":', coalesce(c, 0), '}'), ',' ORDER BY created DESC, id) || ']' AS document FROM t LEFT JOIN n ON l_orderkey = id GROUP BY 1""",
)
def _(spark, sf):
    posts = st.table(spark, sf, "orders").selectExpr("o_custkey % 50 AS source", "o_orderkey AS id", "o_orderdate AS created")
    comments = st.table(spark, sf, "lineitem").selectExpr("l_orderkey AS post_id", "l_shipdate AS created")
    return ds.health_document(posts, comments, 20)
