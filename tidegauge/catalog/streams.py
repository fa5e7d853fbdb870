"""Streaming jobs run over the landed event file until everything available is processed."""

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.sqlkit import MENTIONS, big, r6, ts
from tidegauge.operators import mentions as mn
from tidegauge.operators.windows import best
from tidegauge.plans import standins as st
from tidegauge.session import scratch_path, spread
from tidegauge.sources import merging as mg
from tidegauge.streaming import jobs, snapshots as sn


def stream(spark, sf):
    df = jobs.parquet_stream(spark, sf, "events.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


for _size, _label, _minutes in (("1 minute", "1m", 1), ("5 minutes", "5m", 5), ("1 hour", "1h", 60)):
    query(
        f"stream_tumbling_{_label}",
        f"""WITH b AS (SELECT time_bucket(INTERVAL {_minutes} MINUTE, ts) AS b, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2)
        SELECT {ts('b')} AS bucket_start, event_type, n, {r6('v')} AS value FROM b WHERE b + INTERVAL {_minutes} MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 3 MINUTE""",
    )(lambda spark, sf, size=_size, label=_label: jobs.run_to_end(jobs.tumbling(stream(spark, sf), "ts", size, ["event_type"]), f"tumbling-{label}"))


@query(
    "stream_trailing_rates",
    f"""WITH w AS (SELECT event_type, unnest(range(1, 6)) AS j, ts FROM events), e AS (SELECT event_type, date_trunc('minute', ts) + INTERVAL 1 MINUTE * j AS window_end FROM w)
    SELECT {ts('window_end')} AS window_end, event_type, count(*) AS n FROM e WHERE window_end <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 3 MINUTE GROUP BY window_end, event_type""",
)
def _(spark, sf):
    df = jobs.sliding(stream(spark, sf), "ts", "5 minutes", "1 minute", ["event_type"])
    return jobs.run_to_end(df, "rates").select("window_end", "event_type", "n")


@query(
    "stream_rolling_24h",
    f"""WITH w AS (SELECT event_type, unnest(range(1, 5)) AS j, ts FROM events), e AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR * j AS window_end FROM w)
    SELECT {ts('window_end')} AS window_end, event_type, count(*) AS n FROM e WHERE window_end <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 3 MINUTE GROUP BY window_end, event_type""",
)
def _(spark, sf):
    df = jobs.sliding(stream(spark, sf), "ts", "24 hours", "6 hours", ["event_type"])
    return jobs.run_to_end(df, "rolling").select("window_end", "event_type", "n")


@query("stream_dedupe", f"SELECT event_id, {ts('ts')} AS ts, user_id FROM events")
def _(spark, sf):
    events = stream(spark, sf)
    copies = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("event_id") % 3)))  # one to three deliveries
    return jobs.run_to_end(jobs.deduplicated(copies, ["event_id"], "ts", "40 days").select("event_id", "ts", "user_id"), "dedupe")


_KINDS = ["view", "click", "error", "signup", "purchase"]


@query(
    "stream_cumulative_counts",
    f"""WITH {st.ACTIONS_SQL} SELECT k, {', '.join(f"count(*) FILTER (WHERE event_type = '{x}') AS {x}" for x in _KINDS)}, {ts('max(ts)')} AS last_at FROM actions GROUP BY 1""",
)
def _(spark, sf):
    df = jobs.cumulative_counts(stream(spark, sf), "k", "event_type", _KINDS, "ts")
    out, _ = jobs.run_batches(df, "counts", "update", jobs.write_batch)
    return jobs.totals_of_counts(jobs.latest_state(spark, out, "k", "span_start"), "k", _KINDS)


@query(
    "stream_actor_profiles",
    f"""WITH {st.ACTIONS_SQL} SELECT user_id, {ts('min(ts)')} AS first_at, {ts('max(ts)')} AS last_at, {r6("sum(CASE event_type WHEN 'click' THEN 3.0 WHEN 'error' THEN 4.0 WHEN 'purchase' THEN 4.5 ELSE 1.0 END)")} AS amplification,
    arg_max(k, ts) AS last_target FROM actions GROUP BY 1""",
)
def _(spark, sf):
    w = F.expr("CASE event_type WHEN 'click' THEN 3.0D WHEN 'error' THEN 4.0D WHEN 'purchase' THEN 4.5D ELSE 1.0D END")
    out, _ = jobs.run_batches(jobs.actor_profiles(stream(spark, sf), "user_id", "ts", w, "k"), "profiles", "update", jobs.write_batch)
    return jobs.totals_of_profiles(jobs.latest_state(spark, out, "user_id", "span_start"), "user_id")


@query(
    "stream_append_log",
    f"SELECT event_id, CAST(CAST(CASE WHEN event_id % 50 = 0 THEN ts ELSE ts + INTERVAL 5 SECOND END AS DATE) AS VARCHAR) AS received_date, {ts('CASE WHEN event_id % 50 = 0 THEN ts ELSE ts END')} AS effective_at FROM events",
)
def _(spark, sf):
    df = stream(spark, sf).withColumn(
        "received", F.when(F.col("event_id") % 50 == 0, F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 5 SECONDS")))
    # every fiftieth event carries a clock that runs ahead of its arrival
    df = df.withColumn("event_ts", F.when(F.col("event_id") % 50 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")))
    df = df.select("event_id", F.to_date("received").alias("received_date"), jobs.effective_time("event_ts", "received").alias("effective_at"))
    return jobs.run_to_end(df, "log", partition_by="received_date")


@query("stream_mentions_publish", f"WITH {MENTIONS} SELECT raw_post_id, platform, topic_key, {r6('topic_confidence')} AS topic_confidence FROM mentions")
def _(spark, sf):
    # the batch transforms are reused unchanged on every micro-batch
    def publish(batch, batch_id, out):
        actions = spread(batch).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        facts = mn.sync_mentions(st.topics_of(actions), st.processed_of(actions), mn.alias_rules(batch.sparkSession))
        jobs.write_batch(facts, batch_id, out)

    out, _ = jobs.run_batches(stream(spark, sf), "mentions", "append", publish)
    published = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    # the same fact can be published by two batches; the later batch wins
    facts = best(published, ["raw_post_id", "platform", "topic_key"], [F.col("batch").desc()])
    return facts.select("raw_post_id", "platform", "topic_key", "topic_confidence")


@query("stream_progress", f"SELECT {big('count(*)')} AS input_rows FROM events")
def _(spark, sf):
    _, reports = jobs.run_batches(stream(spark, sf), "progress", "append", jobs.write_batch)
    return jobs.progress_table(spark, reports).agg(F.sum("input_rows").alias("input_rows"))


@query(
    "channel_page_merge",
    "SELECT source, min(doc_id) AS low_id, max(doc_id) AS high_id, count(*) AS messages FROM documents WHERE doc_id % 4 <> 3 GROUP BY 1",
)
def _(spark, sf):
    docs = st.table(spark, sf, "documents").select("source", "doc_id")
    return jobs.merge_pages(docs.where("doc_id % 4 < 2"), docs.where("doc_id % 4 IN (1, 2)"), ["source", "doc_id"], "source", "doc_id")[1]


_COUNTERS = {"likes": "view", "reposts": "click", "replies": "error", "quotes": "purchase"}


@query(
    "stream_snapshots",
    f"""WITH {st.ACTIONS_SQL}, steps AS (SELECT k, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS done, {', '.join(f"count(*) FILTER (WHERE event_type = '{v}') AS d_{n}" for n, v in _COUNTERS.items())}
      FROM actions WHERE k IS NOT NULL AND event_type IN ({', '.join(f"'{v}'" for v in _COUNTERS.values())}) GROUP BY 1, 2),
    closed AS (SELECT *, lag(done) OVER (PARTITION BY k ORDER BY done) AS before FROM steps WHERE done <= (SELECT date_trunc('millisecond', max(ts)) FROM actions WHERE k IS NOT NULL AND event_type IN ({', '.join(f"'{v}'" for v in _COUNTERS.values())})) - INTERVAL 3 MINUTE),
    lives AS (SELECT *, sum(CASE WHEN before IS NULL OR done - before > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY done) AS life FROM closed)
    SELECT 'snapshot:' || left(sha256(concat(k, '|', strftime(done, '%Y-%m-%dT%H:%M:%S'))), 16) AS snapshot_id, k, {ts('done')} AS snapshot_at,
      {', '.join(big(f'sum(d_{n}) OVER w') + f' AS {n}' for n in _COUNTERS)}, {', '.join(f'd_{n} AS delta_{n}' for n in _COUNTERS)},
      {r6("coalesce(epoch(done - lag(done) OVER w) / 60.0, 0)")} AS delta_minutes FROM lives WINDOW w AS (PARTITION BY k, life ORDER BY done)""",
)
def _(spark, sf):
    steps = sn.activity(stream(spark, sf), "k", "event_type", _COUNTERS, "ts")
    with sn.timer_state(spark):
        return jobs.run_to_end(sn.snapshots(steps, "k", list(_COUNTERS), 12 * 60), "snapshots").drop("previous_at")


@query(
    "stream_keyed_merge",
    f"""WITH {MENTIONS}, edits AS (SELECT * FROM mentions WHERE raw_post_id % 6 = 0)
    SELECT m.raw_post_id, m.platform, m.topic_key, m.topic_label, m.author_id,
      {ts('CASE WHEN m.raw_post_id % 12 = 0 THEN m.event_timestamp + INTERVAL 1 DAY ELSE m.event_timestamp END')} AS event_timestamp,
      {ts('CASE WHEN m.raw_post_id % 6 = 0 THEN m.ingested_at + INTERVAL 1 HOUR ELSE m.ingested_at END')} AS ingested_at,
      CASE WHEN m.raw_post_id % 6 = 0 THEN 'neutral' ELSE m.sentiment_label END AS sentiment_label,
      {r6('CASE WHEN m.raw_post_id % 6 = 0 THEN m.quality_score / 2 ELSE m.quality_score END')} AS quality_score, {r6('m.topic_confidence')} AS topic_confidence FROM mentions m""",
)
def _(spark, sf):
    # four deliveries: edits before the facts they edit, every fifth event twice; the table is the same in any order
    landed = scratch_path(spark, "deliveries")
    events = st.table(spark, sf, "events")
    deliveries = F.array_distinct(F.array(F.when(F.col("event_id") % 6 == 0, 0), F.col("event_id") % 3 + 1, F.when(F.col("event_id") % 5 == 0, 3)))
    for n in range(4):
        events.where(F.array_contains(F.filter(deliveries, lambda d: d.isNotNull()), n)).withColumn("delivery", F.lit(n)).coalesce(1).write.mode("append").parquet(landed)
    rows = spark.readStream.schema(spark.read.parquet(landed).schema).option("maxFilesPerTrigger", 1).parquet(landed)
    rules = mn.merge_rules()

    def publish(batch, batch_id, out):
        rows = spread(batch).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
        for edit in (True, False):
            actions = rows.where((F.col("delivery") == 0) if edit else (F.col("delivery") > 0)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
            facts = mn.sync_mentions(st.topics_of(actions), st.processed_of(actions), mn.alias_rules(batch.sparkSession))
            if edit:
                facts = facts.withColumns({
                    "event_timestamp": F.when(F.col("raw_post_id") % 12 == 0, F.expr("event_timestamp + INTERVAL 1 DAY")).otherwise(F.col("event_timestamp")),
                    "ingested_at": F.expr("ingested_at + INTERVAL 1 HOUR"), "sentiment_label": F.lit("neutral"), "quality_score": F.col("quality_score") / 2,
                    "topic_confidence": F.col("topic_confidence") - 0.1, "author_id": F.lit(None).cast("string")})
            mg.merge_days(facts, out, rules, "event_timestamp", horizon_days=2)

    out, _ = jobs.run_batches(rows, "merged-mentions", "append", publish)
    return mg.read_merged(spark, out, rules).drop("processed_post_id", "is_repost", "is_reply", "has_link")
