"""Reports over a run log: line items are runs, their parts topics, their suppliers writers."""

from pyspark.sql import functions as F

from tidegauge.catalog import query
from tidegauge.catalog.mentions import mention_facts
from tidegauge.catalog.sqlkit import DAY_TOTALS, MENTIONS, arr, big, r6, split_list as _split, ts
from tidegauge.operators import diagnostics as dg, rollups as ru
from tidegauge.operators.windows import top_n
from tidegauge.plans import standins as st

_END = "2001-06-01 00:00:00"
_RUNS = """l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey AS {s}) AS topic_key, l_shipdate + INTERVAL 1 MINUTE * (l_orderkey % 1440) AS generated_at,
 CASE l_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'title' WHEN 2 THEN 'enrich' WHEN 3 THEN 'backfill' END AS writer_identity, l_returnflag = 'A' AS authoritative,
 concat('p', l_linestatus) AS prompt_version, concat('m', l_returnflag) AS model_name, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'stale' ELSE 'missing' END AS refresh_reason,
 CAST(l_partkey % 50 AS {s}) AS input_hash, CAST(l_quantity AS BIGINT) AS prompt_tokens, CAST(l_discount * 100 AS BIGINT) AS completion_tokens,
 CAST(l_quantity AS BIGINT) + CAST(l_discount * 100 AS BIGINT) AS total_tokens, CASE WHEN l_linenumber % 3 = 0 THEN 'ready' ELSE 'pending' END AS name_status,
 CASE WHEN l_suppkey % 2 = 0 THEN 'ai_exact' ELSE 'raw' END AS name_source, CASE WHEN l_suppkey % 7 > 0 THEN concat('Name ', l_suppkey) END AS canonical_name"""
RUNS_SQL = f"runs AS (SELECT {_RUNS.format(s='VARCHAR')} FROM lineitem)"
_T = f"TIMESTAMP '{_END}'"


def runs(spark, sf):
    text = _RUNS.format(s="STRING").replace("INTERVAL 1 MINUTE * (l_orderkey % 1440)", "make_interval(0, 0, 0, 0, 0, CAST(l_orderkey % 1440 AS INT), 0)")
    return st.table(spark, sf, "lineitem").selectExpr(*_split(text))


def end():
    return st.as_of_lit(_END)


_W = "coalesce(nullif(trim(writer_identity), ''), 'unknown')"
_SUMS = f"""count(*) AS run_count, {big('sum(prompt_tokens)')} AS prompt_tokens, {big('sum(completion_tokens)')} AS completion_tokens,
 {big('sum(total_tokens)')} AS total_tokens, {ts('max(generated_at)')} AS latest_write_at"""
_w = lambda: dg.named("writer_identity").alias("writer")
_reason = lambda: dg.named("refresh_reason").alias("reason")
_day = lambda: F.date_trunc("day", "generated_at").alias("day")
# name -> (look-back hours, Spark keys, SQL keys, minimum runs)
_REPORTS = {
    "writers_24h": (24, lambda: [_w(), F.col("authoritative")], f"{_W} AS writer, authoritative", 1),
    "writers_7d": (168, lambda: [_w(), F.col("authoritative")], f"{_W} AS writer, authoritative", 1),
    "model_prompt_writer": (168, lambda: [F.col("model_name"), F.col("prompt_version"), _w()], f"model_name, prompt_version, {_W} AS writer", 1),
    "refresh_reasons": (24, lambda: [_reason()], "coalesce(nullif(trim(refresh_reason), ''), 'unknown') AS reason", 1),
    "repeated_topics": (24 * 365, lambda: [F.col("topic_key")], "topic_key", 3),
    "authority_split": (24, lambda: [F.col("authoritative")], "authoritative", 1),
    "daily_writer": (720, lambda: [_day(), _w()], f"{ts(chr(100) + 'ate_trunc(' + chr(39) + 'day' + chr(39) + ', generated_at)')} AS day, {_W} AS writer", 1),
    "daily_model": (720, lambda: [_day(), F.col("model_name"), F.col("prompt_version")], f"{ts('''date_trunc('day', generated_at)''')} AS day, model_name, prompt_version", 1),
    "daily_reason": (720, lambda: [_day(), _reason()], f"{ts('''date_trunc('day', generated_at)''')} AS day, coalesce(nullif(trim(refresh_reason), ''), 'unknown') AS reason", 1),
    "writes_per_hour": (48, lambda: [F.date_trunc("hour", "generated_at").alias("hour")], f"{ts('''date_trunc('hour', generated_at)''')} AS hour", 1),
}
for _name, (_h, _keys, _sqlkeys, _min) in _REPORTS.items():
    query(
        f"runs_{_name}",
        f"WITH {RUNS_SQL} SELECT {_sqlkeys}, {_SUMS} FROM runs WHERE generated_at >= {_T} - INTERVAL {_h} HOUR GROUP BY ALL HAVING count(*) >= {_min}",
    )(lambda spark, sf, h=_h, keys=_keys, m=_min: dg.usage(dg.since(runs(spark, sf), end(), h), *keys(), minimum=m))


@query(
    "runs_expensive_topics",
    f"WITH {RUNS_SQL} SELECT topic_key, {_SUMS} FROM runs WHERE generated_at >= {_T} - INTERVAL 720 HOUR GROUP BY 1 ORDER BY total_tokens DESC, run_count DESC, topic_key LIMIT 100",
)
def _(spark, sf):
    return dg.usage(dg.since(runs(spark, sf), end(), 720), F.col("topic_key")).orderBy(F.desc("total_tokens"), F.desc("run_count"), "topic_key").limit(100)


@query(
    "runs_unknown_writer",
    f"WITH {RUNS_SQL} SELECT id, topic_key, {ts('generated_at')} AS generated_at, model_name, total_tokens FROM runs WHERE {_W} = 'unknown' AND generated_at >= {_T} - INTERVAL 24 HOUR ORDER BY runs.generated_at DESC, id DESC LIMIT 200",
)
def _(spark, sf):
    df = dg.since(runs(spark, sf), end(), 24).where(dg.named("writer_identity") == "unknown")
    return df.orderBy(F.desc("generated_at"), F.desc("id")).limit(200).select("id", "topic_key", "generated_at", "model_name", "total_tokens")


@query(
    "runs_duplicate_fingerprints",
    f"WITH {RUNS_SQL} SELECT topic_key, prompt_version, model_name, input_hash, count(*) AS duplicate_count FROM runs GROUP BY 1, 2, 3, 4 HAVING count(*) > 1",
)
def _(spark, sf):
    return dg.duplicates(runs(spark, sf), ["topic_key", "prompt_version", "model_name", "input_hash"])


for _auth in (True, False):
    _cond = "WHERE name_status = 'ready' AND name_source IN ('ai_exact','historical_exact','historical_alias') AND canonical_name IS NOT NULL" if _auth else ""
    query(
        f"runs_latest_{'authoritative' if _auth else 'any'}",
        f"WITH {RUNS_SQL} SELECT topic_key, id, canonical_name, {ts('generated_at')} AS generated_at FROM runs {_cond} QUALIFY row_number() OVER (PARTITION BY topic_key ORDER BY runs.generated_at DESC, id DESC) = 1",
    )(lambda spark, sf, auth=_auth: dg.latest_per_topic(runs(spark, sf), auth).select("topic_key", "id", "canonical_name", "generated_at"))


@query(
    "runs_silent_writers",
    f"""WITH {RUNS_SQL}, h AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'enrich' ELSE 'other' END AS writer, o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 700) AS last_seen_at FROM orders),
    w AS (SELECT {_W} AS writer, max(generated_at) AS lw, count(*) AS run_count FROM runs WHERE generated_at >= {_T} - INTERVAL 24 HOUR GROUP BY 1),
    b AS (SELECT writer, max(last_seen_at) AS lh FROM h WHERE last_seen_at >= {_T} - INTERVAL 24 HOUR GROUP BY 1)
    SELECT writer, {ts('lw')} AS latest_write_at, run_count, {ts('lh')} AS latest_heartbeat_at FROM w LEFT JOIN b USING (writer) WHERE lh IS NULL OR lh < lw - INTERVAL 15 MINUTE""",
)
def _(spark, sf):
    beats = st.table(spark, sf, "orders").selectExpr(
        "CASE o_custkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'enrich' ELSE 'other' END AS writer",
        "o_orderdate + make_interval(0, 0, 0, 0, 0, CAST(o_orderkey % 700 AS INT), 0) AS last_seen_at")
    return dg.silent_writers(runs(spark, sf), beats, end())


@query(
    "runs_writer_report",
    f"""WITH {RUNS_SQL}, s AS (SELECT * FROM runs WHERE generated_at >= {_T} - INTERVAL 24 HOUR),
    a AS (SELECT {_W} AS writer, authoritative, count(*) AS run_count, {big('sum(total_tokens)')} AS total_tokens FROM s GROUP BY 1, 2),
    b AS (SELECT model_name, count(*) AS run_count, {big('sum(total_tokens)')} AS total_tokens FROM s GROUP BY 1)
    SELECT count(*) AS run_count, bool_or({_W} = 'unknown') AS has_unknown, count(*) FILTER (WHERE NOT authoritative) AS unauthorised,
     (SELECT '[' || string_agg(concat('{{"writer":"', writer, '","authoritative":', authoritative, ',"run_count":', run_count, ',"total_tokens":', total_tokens, '}}'), ',' ORDER BY run_count DESC, writer, authoritative) || ']' FROM a) AS writers,
     (SELECT '[' || string_agg(concat('{{"model_name":"', model_name, '","run_count":', run_count, ',"total_tokens":', total_tokens, '}}'), ',' ORDER BY run_count DESC, model_name) || ']' FROM b) AS models FROM s""",
)
def _(spark, sf):
    return dg.writer_report(runs(spark, sf), end())


_NAMES = """CAST(p_partkey AS {s}) AS topic_key, p_name AS raw_label, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN NULL ELSE concat('The ', p_name) END AS canonical_name,
 CASE p_size % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'mixed' ELSE 'junk' END AS status, CASE WHEN p_partkey % 9 = 0 THEN 'Using the cleaned fallback label here' END AS summary,
 CASE WHEN p_partkey % 10 = 0 THEN 'visible runtime AI naming failed' END AS abstain_reason, p_partkey % 4 AS evidence_count"""


@query(
    "name_pollution_report",
    f"""WITH e AS (SELECT {_NAMES.format(s='VARCHAR')} FROM part), r AS (SELECT CASE WHEN lower(coalesce(summary, '')) LIKE '%using the cleaned fallback label%' THEN 'fallback_narrative'
      WHEN lower(coalesce(abstain_reason, '')) LIKE '%visible runtime ai naming failed%' THEN 'runtime_failure'
      WHEN status IN ('ok','mixed') AND canonical_name IS NOT NULL AND lower(canonical_name) = lower(raw_label) THEN 'canonical_equals_raw'
      WHEN status IN ('ok','mixed') AND evidence_count = 0 THEN 'missing_evidence'
      WHEN status IN ('ok','mixed') AND regexp_matches(regexp_replace(lower(raw_label), '[^a-z0-9]+', '', 'g'), '(apital|eneral|etting|hased|arket|tion|ment|ally|ized)$') THEN 'fragment_like_raw_label' END AS reason FROM e)
    SELECT reason, count(*) AS row_count FROM r WHERE reason IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    df = st.table(spark, sf, "part").selectExpr(*_split(_NAMES.format(s="STRING")))
    return df.withColumn("reason", dg.pollution_reason()).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "read_model_consistency",
    f"""WITH {DAY_TOTALS}, a AS (SELECT day, topic_key, total_mentions FROM day_totals), b AS (SELECT CAST(event_timestamp AS DATE) AS day, topic_key, count(*) AS facts FROM mentions GROUP BY 1, 2)
    SELECT CAST(coalesce(a.day, b.day) AS VARCHAR) AS day, coalesce(a.topic_key, b.topic_key) AS topic_key, coalesce(total_mentions, 0) AS total_mentions, coalesce(facts, 0) AS facts,
    coalesce(total_mentions, 0) - coalesce(facts, 0) AS delta FROM a FULL JOIN b ON a.day = b.day AND a.topic_key = b.topic_key""",
)
def _(spark, sf):
    facts = mention_facts(spark, sf)
    totals = ru.day_totals(ru.final_minutes(facts), facts)
    direct = facts.groupBy(F.to_date("event_timestamp").alias("day"), "topic_key").agg(F.count(F.lit(1)).alias("facts"))
    return dg.reconcile(totals, direct, ["day", "topic_key"], "total_mentions", "facts")


@query(
    "extraction_coverage",
    f"""WITH {MENTIONS}, w AS (SELECT max(event_timestamp) AS e FROM mentions), a AS (SELECT platform, count(*) AS n FROM post_topics, w WHERE source_created_at >= e - INTERVAL 24 HOUR AND source_created_at < e GROUP BY 1),
    b AS (SELECT platform, count(*) AS n FROM mentions, w WHERE event_timestamp >= e - INTERVAL 24 HOUR AND event_timestamp < e GROUP BY 1)
    SELECT platform, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM (SELECT DISTINCT event_type AS platform FROM events) LEFT JOIN a USING (platform) LEFT JOIN b USING (platform)""",
)
def _(spark, sf):
    facts, topics = mention_facts(spark, sf), st.post_topics(spark, sf)
    end_at = facts.agg(F.max("event_timestamp")).scalar()
    inside = lambda df, x: df.withColumn("__e", end_at).where((F.col(x) >= F.col("__e") - F.expr("INTERVAL 24 HOURS")) & (F.col(x) < F.col("__e")))
    keys = st.table(spark, sf, "events").select(F.col("event_type").alias("platform")).distinct()
    return dg.coverage(keys, inside(topics, "source_created_at"), inside(facts, "event_timestamp"), "platform")


_STATE = """CAST(p_partkey AS {s}) AS topic_key, CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 8 = 1 THEN '' ELSE CAST(p_size % 5 AS {s}) END AS stored_hash, CAST(p_size % 4 AS {s}) AS input_hash,
 CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 6 = 0 THEN 'v1' ELSE 'v2' END AS prompt_version, CASE WHEN p_partkey % 5 = 0 THEN 'm1' ELSE 'm2' END AS model_name,
 CASE WHEN p_partkey % 7 = 0 THEN {t} '2001-05-01 00:00:00' END AS expires_at, CASE WHEN p_partkey % 8 = 0 OR p_partkey % 11 = 0 THEN NULL ELSE {t} '2001-05-31 00:00:00' - INTERVAL {i} END AS refreshed_at"""


@query(
    "refresh_due",
    f"""WITH s AS (SELECT {_STATE.format(s='VARCHAR', t='TIMESTAMP', i='1 HOUR * p_size')} FROM part), r AS (SELECT topic_key, CASE WHEN stored_hash IS NULL AND refreshed_at IS NULL THEN 'missing' WHEN coalesce(stored_hash, '') = '' THEN 'missing_hash' WHEN prompt_version <> 'v2' THEN 'prompt_version_changed' WHEN model_name <> 'm2' THEN 'model_changed'
      WHEN expires_at <= {_T} THEN 'expired' WHEN refreshed_at IS NULL THEN 'missing_timestamp' WHEN stored_hash <> input_hash AND refreshed_at + INTERVAL 36 HOUR <= {_T} THEN 'input_hash_changed' WHEN stored_hash <> input_hash THEN 'input_hash_changed_during_cooldown'
      WHEN refreshed_at + INTERVAL 48 HOUR <= {_T} THEN 'stale' ELSE 'unchanged' END AS reason FROM s) SELECT topic_key, reason, reason NOT IN ('unchanged','input_hash_changed_during_cooldown') AS due FROM r""",
)
def _(spark, sf):
    text = _STATE.format(s="STRING", t="TIMESTAMP_NTZ", i="0 HOURS").replace("INTERVAL 0 HOURS", "make_interval(0, 0, 0, 0, p_size, 0, 0)")
    df = st.table(spark, sf, "part").selectExpr(*_split(text))
    return dg.refresh_due(df, end(), "m2", "v2", 48, 36).select("topic_key", "reason", "due")


@query(
    "enrichment_nearest_window",
    f"""WITH {RUNS_SQL} SELECT topic_key, id, {ts('generated_at')} AS generated_at FROM runs WHERE abs(floor(epoch(generated_at)) - floor(epoch({_T}))) <= 180 * 60
    QUALIFY row_number() OVER (PARTITION BY topic_key ORDER BY total_tokens DESC, runs.generated_at DESC, id DESC) = 1""",
)
def _(spark, sf):
    return dg.nearest_window(runs(spark, sf), "topic_key", end(), "generated_at", 180,
                             [F.col("total_tokens").desc(), F.col("generated_at").desc(), F.col("id").desc()]).select("topic_key", "id", "generated_at")


@query(
    "live_status",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'disconnected' WHEN o_custkey % 10 = 0 THEN 'stale' WHEN o_custkey % 500 <= 30 THEN 'live' WHEN o_custkey % 500 <= 120 THEN 'delayed' ELSE 'stale' END AS state FROM orders",
)
def _(spark, sf):
    age = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey") % 500)
    return st.table(spark, sf, "orders").select("o_orderkey", dg.live_status(F.col("o_orderstatus") != "F", age).alias("state"))


@query(
    "token_cost",
    f"""WITH {RUNS_SQL}, u AS (SELECT model_name, sum(prompt_tokens) AS p, sum(completion_tokens) AS q FROM runs GROUP BY 1), pr AS (SELECT DISTINCT concat('m', l_returnflag) AS model_name, 0.5 + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS a FROM lineitem)
    SELECT model_name, {r6('p / 1e6 * a + q / 1e6 * a * 4')} AS cost FROM u LEFT JOIN pr USING (model_name)""",
)
def _(spark, sf):
    prices = st.table(spark, sf, "lineitem").select("l_returnflag").distinct().selectExpr(
        "concat('m', l_returnflag) AS model_name", "0.5D + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS prompt_price").withColumn(
        "completion_price", F.col("prompt_price") * 4)
    return dg.token_cost(dg.usage(runs(spark, sf), F.col("model_name")), prices).select("model_name", "cost")
