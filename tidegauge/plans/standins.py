"""The given tables seen as the datasets the operators work on, with the same derivation as SQL for the oracle.

Each dataset is a projection of a whole given table: nothing is sampled, capped or generated from nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.session import spread

AS_OF = "2024-01-30 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "events", "lineitem") else df


def as_of_lit(text: str = AS_OF):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


# event -> topic wording: ten families, the number of the family member appended
_TOPIC_CASE = """CASE {k} % 10
 WHEN 0 THEN 'No-Kings' WHEN 1 THEN '#bsky' WHEN 2 THEN 'United States' WHEN 3 THEN 'Area Forecast AFD'
 WHEN 4 THEN 'weatherbot update' WHEN 5 THEN 'one two' WHEN 6 THEN 'Iranian'
 WHEN 7 THEN concat('Market''s Rally ', {g}) WHEN 8 THEN concat('Solar Storm ', {g})
 ELSE concat('Open Source ', {g}) END"""
_KIND_CASE = """CASE event_type WHEN 'click' THEN 'keyword' WHEN 'error' THEN 'hashtag'
 WHEN 'signup' THEN 'cashtag' ELSE 'entity' END"""
_SENTIMENT_CASE = "CASE event_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' END"


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the JSON subject number read out."""
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


ACTIONS_SQL = "actions AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def processed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processed_of(actions(spark, sf_dir))


def processed_of(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "event_id AS raw_post_id", "event_id AS processed_post_id", "event_type AS platform",
        "CAST(user_id AS STRING) AS author_id", "ts AS source_created_at",
        "date_trunc('minute', ts) AS bucket_minute",
        "ts + INTERVAL 2 MINUTES AS processed_at",
        f"{_SENTIMENT_CASE} AS sentiment_label",
        "least(1.0D, greatest(0.0D, value / 100.0D)) AS quality_score",
        "event_type = 'click' AS is_repost", "event_type = 'error' AS is_reply",
        "IF(event_type = 'purchase', array(concat('https://x.example/', k)), array()) AS urls",
        "IF(event_id % 11 = 0, 'no king', concat('solar storm ', CAST(k DIV 10 AS STRING))) AS topic_key_candidate",
    )


PROCESSED_SQL = f"""processed AS (SELECT event_id AS raw_post_id, event_id AS processed_post_id, event_type AS platform,
 CAST(user_id AS VARCHAR) AS author_id, ts AS source_created_at, date_trunc('minute', ts) AS bucket_minute,
 ts + INTERVAL 2 MINUTE AS processed_at, {_SENTIMENT_CASE} AS sentiment_label,
 least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 100.0::DOUBLE)) AS quality_score,
 event_type = 'click' AS is_repost, event_type = 'error' AS is_reply, event_type = 'purchase' AS has_link,
 CASE WHEN event_id % 11 = 0 THEN 'no king' ELSE concat('solar storm ', CAST(k // 10 AS VARCHAR)) END AS topic_key_candidate
 FROM actions)"""


def post_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics_of(actions(spark, sf_dir))


def topics_of(rows: DataFrame) -> DataFrame:
    """Two topic records for every third event, none for every thirteenth, one for the others."""
    base = rows.where("event_id % 13 <> 0")
    case = _TOPIC_CASE.format(k="k", g="CAST(k DIV 10 AS STRING)")
    records = F.expr(
        f"""filter(array(struct({case} AS topic_text, {_KIND_CASE} AS topic_type),
        IF(event_id % 3 = 0, struct(concat('Breaking Event ', CAST(user_id % 7 AS STRING)) AS topic_text,
           'entity' AS topic_type), NULL)), r -> r IS NOT NULL)"""
    )
    return base.select(
        F.col("event_id").alias("raw_post_id"), F.col("event_id").alias("processed_post_id"),
        F.col("event_type").alias("platform"), F.col("ts").alias("source_created_at"),
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("bucket_minute"),
        F.inline(records),
    ).withColumn("normalized_topic", F.col("topic_text"))


POST_TOPICS_SQL = f"""post_topics AS (
 SELECT event_id AS raw_post_id, event_id AS processed_post_id, event_type AS platform, ts AS source_created_at,
   date_trunc('minute', ts) AS bucket_minute, {_TOPIC_CASE.format(k='k', g='CAST(k // 10 AS VARCHAR)')} AS topic_text,
   {_KIND_CASE} AS topic_type FROM actions WHERE event_id % 13 <> 0
 UNION ALL
 SELECT event_id, event_id, event_type, ts, date_trunc('minute', ts),
   concat('Breaking Event ', CAST(user_id % 7 AS VARCHAR)), 'entity' FROM actions
 WHERE event_id % 13 <> 0 AND event_id % 3 = 0)"""


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts: the text plus a tag, cashtag, mention and link derived from the row."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source", "lang",
        "concat(text, ' #', source, ' $', upper(lang), 'COIN @user', CAST(doc_id % 17 AS STRING), "
        "' https://www.', source, '.example/p/', CAST(doc_id AS STRING), '?utm_source=x&id=', CAST(doc_id % 5 AS STRING), '.') AS text",
        "n_chars",
    )


RAW_POSTS_SQL = """raw_posts AS (SELECT doc_id, source, lang, concat(text, ' #', source, ' $', upper(lang), 'COIN @user',
 CAST(doc_id % 17 AS VARCHAR), ' https://www.', source, '.example/p/', CAST(doc_id AS VARCHAR), '?utm_source=x&id=',
 CAST(doc_id % 5 AS VARCHAR), '.') AS text, n_chars FROM documents)"""


# posts whose wording follows the event: some name a keyword of the scope
_MEME_TEXT = """concat('Post ', event_id, CASE event_id % 6 WHEN 0 THEN ' memecoin drop' WHEN 1 THEN ' a new Meme template' WHEN 2 THEN ' viral clip' ELSE ' plain words' END)"""
MEME_SQL = f"SELECT event_id, {_MEME_TEXT} AS text FROM events"


def meme_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_MEME_TEXT} AS text")
